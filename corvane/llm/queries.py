"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, linededup, media, packing, shards, topk, toxicity, urlfilter, warc

#: (action, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def vocabulary(name: str) -> str:
    """A file of the public tokenizers; CORVANE_TOKENIZERS names another folder that has it."""
    if folder := os.environ.get("CORVANE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, least=85, of=100)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), 24)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("n_runs", F.size("runs")).drop("runs")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_LETTERS = f"'{urlfilter.UPPER}', '{urlfilter.LOWER}'"

ORACLES = {
    "op1_top_k_inner_product": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT g.doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(reached) FROM r WHERE r.doc_id = g.doc_id) AS component_id FROM g""",
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ln, len(regexp_split_to_array(trim(line, ' '), ' +')) AS words FROM l WHERE regexp_matches(line, '\S')),
a AS (SELECT doc_id, list(line ORDER BY ln) AS lines, list(words ORDER BY ln) AS words FROM n GROUP BY doc_id),
i AS (SELECT *, unnest(range(1, len(lines) + 1)) AS ln FROM a),
w AS (SELECT doc_id, ln, size, lines[ln : ln + size - 1] AS part FROM i, range(1, 11) r(size) WHERE ln + size - 1 <= len(lines) AND list_sum(words[ln : ln + size - 1]) >= 10),
c AS (SELECT doc_id, ln, size FROM w QUALIFY row_number() OVER (PARTITION BY part ORDER BY doc_id, ln) > 1),
m AS (SELECT DISTINCT doc_id, unnest(range(ln, ln + size)) AS ln FROM c),
f AS (SELECT n.doc_id, n.pos, n.ln, m.ln IS NOT NULL AS gone FROM n LEFT JOIN m ON n.doc_id = m.doc_id AND n.ln = m.ln),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY ln), FALSE) AS begins FROM f),
k AS (SELECT l.doc_id, l.pos, l.line, e.gone AS marked, e.begins, coalesce(last_value(e.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.pos), FALSE) AS gone FROM l LEFT JOIN e ON l.doc_id = e.doc_id AND l.pos = e.pos),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (marked) AS n_deleted, count(*) FILTER (begins) AS n_runs FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
  (CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_lines END)::INTEGER AS n_lines, coalesce(n_deleted, 0)::INTEGER AS n_deleted, coalesce(n_runs, 0)::INTEGER AS n_runs FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op7_warc_archives": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS head FROM s)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM g""",
    "op9_url_rules": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
k AS (SELECT page_id, translate(raw, {_LETTERS}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(action, rhost, rpath) AS (VALUES {", ".join(map(str, URL_RULES))}),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM k JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT k.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM k LEFT JOIN m ON k.page_id = m.page_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
