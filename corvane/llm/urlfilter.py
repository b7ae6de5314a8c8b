"""URL rules by a Bloom filter cascade (native: DataFrame functions only).

Level 1 encodes the listed keys; level 2 the false positives of level 1 over the corpus's complete
key universe; level 3 the listed keys that level 2 lets through; and so on until a level has no
false positive. A key of the universe is listed iff the first level that says no is an even one,
so each row is judged by bit tests on literals, exactly and without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that a cascade may encode (about 6 MB of bits); longer lists are joined instead.
MAX_LISTED = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys (host suffix at a label, path prefix of a length that occurs in the rules), longest first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in path_lengths])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(
        F.filter(lengths, lambda n: n <= F.length(path)),
        lambda n: F.struct((-(F.length(s) + n)).alias("total"), (-F.length(s)).alias("own"), s.alias("host"), F.substring(path, F.lit(1), n).alias("path")),
    )))
    return F.array_sort(keys)


def key_text(key: Column) -> Column:
    return F.concat(key["host"], F.lit("\u0000"), key["path"])


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]

    def positions(self, key: Column, number: int) -> Column:
        """array<bigint> of the key's bits."""
        h = F.transform(F.array(F.xxhash64(key, F.lit(number))), lambda h: F.struct(h.bitwiseAND(F.lit(0x7FFFFFFF)).alias("a"), F.shiftrightunsigned(h, 33).alias("b")))[0]
        steps = F.array(*[F.lit(j).cast("bigint") for j in range(self.hashes)])
        return F.transform(F.array(h), lambda h: F.transform(steps, lambda j: F.pmod(h["a"] + h["b"] * j, F.lit(self.bits))))[0]

    def holds(self, key: Column, number: int) -> Column:
        # a foldable expression: the optimizer turns it into one array literal, read in place
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.forall(self.positions(key, number), lambda p: F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1)


class Cascade:
    """Exact membership for the keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)  # all levels say yes: what the last one encodes
        for i in range(len(self.levels), 0, -1):
            out = F.when(self.levels[i - 1].holds(key, i), out).otherwise(F.lit(i % 2 == 0))
        return out


def _rows(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.string())}))


def _level(spark: SparkSession, keys: list[str], number: int, rate: float) -> Level:
    bits = max(64, 64 * math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2 / 64))
    level = Level(bits, max(1, round(bits / max(1, len(keys)) * math.log(2))) if keys else 1, [])
    level.hashes = min(level.hashes, 8)
    p = _rows(spark, keys).select(F.explode(level.positions(F.col("key"), number)).alias("p"))
    found = p.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits"))
    words = {r["word"]: r["bits"] for r in found.collect()}  # at most bits / 64 rows
    level.words = [words.get(i, 0) for i in range(bits // 64)]
    return level


def build_cascade(spark: SparkSession, listed: Iterable[str], universe: DataFrame, universe_size: int, max_listed: int = MAX_LISTED, rate: float | None = None) -> Cascade | None:
    """universe: the corpus's keys (column key), repeats allowed. None if a level's keys pass the bound.

    The first level's rate is set so that about as many false positives as listed keys are left.
    """
    listed = sorted(set(listed))
    if not listed:
        return Cascade([])
    if len(listed) > max_listed:
        return None
    first = rate or min(0.5, max(1e-9, len(listed) / max(1, universe_size)))
    levels = [_level(spark, listed, 1, first)]
    known = _rows(spark, listed)
    wrong = universe.filter(levels[0].holds(F.col("key"), 1)).distinct().join(known, "key", "left_anti")
    encode, other = [r["key"] for r in wrong.take(max_listed + 1)], listed
    if len(encode) > max_listed:
        return None
    while encode:
        number = len(levels) + 1
        levels.append(_level(spark, encode, number, 0.5 if number % 2 else 0.25))
        through = [r["key"] for r in _rows(spark, other).filter(levels[-1].holds(F.col("key"), number)).collect()]
        encode, other = through, encode
    return Cascade(levels)


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    default: str = "allow", max_listed: int = MAX_LISTED, rate: float | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    rules: (action ``allow`` or ``block``, host, path). A rule fits its host and all subdomains if
    the url's path starts with the rule's path; the longest (host and path together) wins. Where no
    rule fits, the filter's own verdict is ``default``: an unlisted key isn't blocked.
    Null urls, and such without ``://``: empty host and path, no rule. Repeated rows are judged
    alike; an empty table gives an empty result. A key both allowed and blocked is an error.
    """
    spark = pages.sparkSession
    listed = {a: {f"{h.translate(str.maketrans(UPPER, LOWER))}\u0000{p}" for x, h, p in rules if x == a} for a in ("allow", "block")}
    if listed["allow"] & listed["block"] or any(x not in listed for x, _, _ in rules):
        raise ValueError("each key needs one action, allow or block")
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    keyed = rows.withColumn("keys", rule_keys(F.col("host"), F.col("path"), lengths) if lengths else F.lit(None).cast("array<struct<total:int,own:int,host:string,path:string>>"))
    universe = keyed.select(F.explode("keys").alias("k")).select(key_text(F.col("k")).alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    cascades = {a: build_cascade(spark, listed[a], universe, size, max_listed, rate) for a in listed}
    if None in cascades.values():
        return _judge_by_join(spark, keyed, rules, default)
    member = lambda k: cascades["allow"].contains(key_text(k)) | cascades["block"].contains(key_text(k))
    best = F.try_element_at(F.filter("keys", member), F.lit(1))
    chosen = keyed.select("page_id", "host", "path", best.alias("best"))
    rule = F.concat(F.col("best.host"), F.col("best.path"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(cascades["block"].contains(key_text(F.col("best"))), F.lit("block")).otherwise(F.lit("allow"))
    return chosen.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _judge_by_join(spark: SparkSession, keyed: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """Beyond the bound: the rows' keys are joined with the list (a hash join on the key)."""
    table = spark.createDataFrame([(f"{h.translate(str.maketrans(UPPER, LOWER))}\u0000{p}", x) for x, h, p in rules], "key string, action string").distinct()
    ids = keyed.select("page_id", "host", "path", "keys").withColumn("row", F.monotonically_increasing_id())
    hits = ids.select("row", "page_id", "host", "path", F.explode_outer("keys").alias("k")).withColumn("key", key_text(F.col("k"))).join(table, "key", "left")
    best = F.min(F.when(F.col("action").isNotNull(), F.struct("k.total", "k.own", "k.host", "k.path", "action"))).alias("best")
    out = hits.groupBy("row", "page_id", "host", "path").agg(best)
    return out.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
