import math
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm.shards import assign_shards
from corvane.llm.urlfilter import judge_urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "x.net", "/es/a")]
URLS = [
    "http://WWW.Example.com/en/1", "https://a.example.com/en/x?y", "https://example.com/en", "http://example.com/de/", "http://b.net/es/1#f", "net", None, "", "http://x.net/es/abc", "http://x.net/es/b",
    "ftp://examplexcom/en/", "http://com", "http://com/?/en/", "://net/fr/", "http://ÄB.COM/", "http://a.b.c.net:80/fr/", "http://net/fr/", "x://y://net/es/", "http://u@example.com/en/", "http://" + "a." * 30 + "net/es/",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, action = max(fits, default=(0, None, "allow"))
    return host, path, rule, action


@pytest.mark.parametrize("options", [{}, {"rate": 0.5}, {"max_listed": 1}])
def test_urls(spark, options):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES, **options)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: judge(u) for i, u, _ in rows}


def test_many_listed_keys_need_levels(spark):
    rules = [("block", f"h{i}.org", "/") for i in range(300)]
    rows = [(i, f"http://h{i}.org/") for i in range(1200)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, rate=0.5)
    assert {r.page_id for r in got.filter("verdict = 'block'").collect()} == set(range(300))


def race(key, shard, weight):
    """xxHash64 of the key and then the shard, each as little-endian bytes, chained by the seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=h)
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight, shard


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 4.0, 0.5]])
def test_shards_by_brute_force(spark, weights):
    keys = [*range(-50, 250), 2**62, -(2**62)]
    df = spark.createDataFrame([(k, f"t{k}é", 1) for k in keys], "doc_id long, text string, shard int")
    got = {r.doc_id: r for r in assign_shards(df, len(weights), weights=weights).collect()}
    for k in keys:
        best = min(race(k, s, w) for s, w in enumerate(weights))[1]
        grown = min(race(k, s, w) for s, w in enumerate([*weights, 1.0]))[1]
        assert (got[k].shard, got[k].grown_shard) == (best, grown) and grown in (best, len(weights))
        assert (got[k].size, got[k].text_crc32) == (len(f"t{k}é".encode()) + 8, zlib.crc32(f"t{k}é".encode()))
    for s in range(len(weights)):
        own = sorted(r.slot for r in got.values() if r.shard == s)
        assert own == list(range(len(own)))


def test_urls_of_an_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    with pytest.raises(ValueError, match="one action"):
        judge_urls(spark.createDataFrame([], "page_id long, url string"), [("allow", "a", "/"), ("block", "A", "/")])


def test_shards(spark):
    import zlib

    rows = [(i, f"text {i % 50}", 1) for i in range(3000)] + [(7, "text 7", 1), (None, None, 1), (None, "", 1)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 24, chunks=8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.4 * 3000 / 24
    assert 60 < sum(r.shard != r.grown_shard for r in got) < 190  # about one in 25
    seven = [r for r in got if r.doc_id == 7]
    assert len(seven) == 2 and len({r.shard for r in seven}) == 1 and seven[0].text_crc32 == zlib.crc32(b"text 7") and seven[0].size == 14
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(8, 0)}


def test_weights(spark):
    got = assign_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 2, weights=[3.0, 1.0])
    assert 0.7 < got.filter("shard = 0").count() / 4000 < 0.8
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
