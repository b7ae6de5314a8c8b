"""Matching titles against catalogs by normalized containment in either direction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corvane.scratch import settled, small_batches

#: Characters of the anchor by which a longer key is looked up, rows up to which anchors and candidate pairs are broadcast,
#: and characters up to which a side's keys are.
GRAM, FEW_PAIRS, FEW_CHARS = 8, 1_000_000, 8_000_000
#: Hashes that a worker collects before it hands them on, and bits of the numbers by which known anchors are marked.
MOST, SLOTS = 100_000, 24
# Odd multipliers of the characters of a gram, and that of the finalizer.
_STEPS = (np.random.default_rng(1).integers(1 << 63, 1 << 64, GRAM, np.uint64)) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _hashes(key: str, size: int) -> np.ndarray:
    """64-bit hashes of the distinct substrings of a length; a shorter key is its own."""
    c = np.frombuffer(key.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = min(size, len(c))
    h = np.full(len(c) - n + 1, n, np.uint64)
    for i in range(n):
        h += (c[i : len(h) + i] + np.uint64(1)) * _STEPS[i]
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def _anchors(short: DataFrame) -> DataFrame:
    """r, n, g: the length and the hash of each key's anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            g = np.array([_hashes(k, GRAM)[0] for k in keys], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([min(GRAM, len(k)) for k in keys], pa.int32()), pa.array(g.view(np.int64))], ["r", "n", "g"])

    return short.mapInArrow(run, S.StructType([short.schema["r"], S.StructField("n", S.IntegerType()), S.StructField("g", S.LongType())]))


def _slots(g: np.ndarray) -> np.ndarray:
    return g.view(np.uint64) >> np.uint64(64 - SLOTS)


def _grams(long: DataFrame, sizes: list[int], known: np.ndarray | None) -> DataFrame:
    """l, n, g: the hashes of each key's grams; without most of those that aren't among the known ones, if these are given."""
    sent = None
    if known is not None:
        marks = np.zeros(1 << SLOTS, bool)
        marks[_slots(known)] = True
        sent = long.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if sent is None else np.unpackbits(sent.value).view(bool)
        for batch in batches:
            at, n, g, held = [], [], [], 0
            for k, key in enumerate(batch.column(1).to_pylist()):
                for size in sizes:
                    if len(key) >= size:
                        found = _hashes(key, size)
                        found = found if marks is None else found[marks[_slots(found)]]
                        at.append(np.full(len(found), k))
                        n.append(np.full(len(found), size, np.int32))
                        g.append(found.view(np.int64))
                        held += len(found)
                if at and (held > MOST or k == len(batch) - 1):
                    columns = [batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(n)), pa.array(np.concatenate(g))]
                    yield pa.RecordBatch.from_arrays(columns, ["l", "n", "g"])
                    at, n, g, held = [], [], [], 0

    return long.mapInArrow(run, S.StructType([long.schema["l"], S.StructField("n", S.IntegerType()), S.StructField("g", S.LongType())]))


def containment_pairs(left: DataFrame, right: DataFrame, left_id: str, left_key: str, right_id: str, right_key: str) -> DataFrame:
    """left_id, right_id of all pairs where one key contains the other; blank keys match nothing.

    Each key has an anchor, the one of its grams with the least hash (a key shorter than a gram is
    its own). A key that contains another one contains its anchor: rows meet in ids and hashes, and
    only candidates are compared as texts.
    """
    small_batches(left.sparkSession)
    # written once, and filtered afterwards, or the filter makes them too: keys are dear to make, and are read for anchors, grams and the comparison
    lt = settled(left.select(F.col(left_id).alias("l"), F.col(left_key).alias("lk"))).filter("lk <> ''")
    rt = settled(right.select(F.col(right_id).alias("r"), F.col(right_key).alias("rk"))).filter("rk <> ''")
    swapped = _contained(rt.toDF("l", "lk"), lt.toDF("r", "rk")).select(F.col("r").alias("l"), F.col("l").alias("r"))
    return _contained(lt, rt).unionByName(swapped).distinct().select(F.col("l").alias(left_id), F.col("r").alias(right_id))


def _contained(long: DataFrame, short: DataFrame) -> DataFrame:
    """l, r of the pairs whose first key contains the second."""
    # a key over the longest one of the other side is contained in none
    longest, long_chars = long.agg(*(F.coalesce(f(F.length("lk")), F.lit(0)) for f in (F.max, F.sum))).first()
    short = short.filter(F.length("rk") <= longest)
    anchors = settled(_anchors(short))
    sizes = {row["n"]: row["count"] for row in anchors.groupBy("n").count().collect()}  # GRAM values at most
    if not sizes:
        return long.select("l").limit(0).join(short.select("r"), F.lit(False))
    few = sum(sizes.values()) <= FEW_PAIRS
    known = anchors.select("g").distinct().toArrow()["g"].to_numpy() if few else None
    pairs = settled(_grams(long, sorted(sizes), known).join(F.broadcast(anchors) if few else anchors, ["n", "g"]).select("l", "r"))
    small = F.broadcast if pairs.count() <= FEW_PAIRS else (lambda df: df)
    short_chars = short.agg(F.coalesce(F.sum(F.length("rk")), F.lit(0))).first()[0]
    # where the texts of a side are few, only ids move
    if min(short_chars, long_chars) > FEW_CHARS:
        texts = long.join(small(pairs), "l").join(short, "r")
    elif short_chars <= long_chars:
        texts = long.join(small(pairs), "l").join(F.broadcast(short), "r")
    else:
        texts = short.join(small(pairs), "r").join(F.broadcast(long), "l")
    return texts.filter(F.contains("lk", "rk")).select("l", "r")


def candidate_status(candidates: DataFrame, flags: dict[str, DataFrame], id_col: str, fresh: str = "新") -> DataFrame:
    """Adds status: the labels of the flag tables (each with id_col) that hold a candidate, joined by `` / ``; else ``fresh``."""
    out = candidates
    for i, ids in enumerate(flags.values()):
        out = out.join(ids.select(id_col).distinct().withColumn(f"_flag{i}", F.lit(1)), id_col, "left")
    labels = F.concat_ws(" / ", *[F.when(F.col(f"_flag{i}") == 1, F.lit(name)) for i, name in enumerate(flags)])
    return out.withColumn("status", F.coalesce(F.nullif(labels, F.lit("")), F.lit(fresh))).drop(*[f"_flag{i}" for i in range(len(flags))])


def best_candidates(found: DataFrame, title_col: str, order_col: str, n: int = 1) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(title_col).orderBy(order_col))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by order."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, F.col(order)).alias("_row")).select(key, "_row.*")


def new_candidates(candidates: DataFrame, fresh: str = "新") -> DataFrame:
    """n_candidates, n_new of candidates (status)."""
    return candidates.agg(F.count("*").alias("n_candidates"), F.count_if(F.col("status") == fresh).alias("n_new"))


def candidate_view(candidates: DataFrame) -> DataFrame:
    """What a listing shows: introductions up to 70 characters, publishers up to 12."""
    return candidates.withColumns({"intro": F.substring("intro", 1, 70), "publisher": F.substring("publisher", 1, 12)})


def search_url(title: Column, base: str) -> Column:
    """The search address of a title: percent-encoded, a space as %20."""
    return F.concat(F.lit(base), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")))


def folder_gate(wanted: DataFrame, items: DataFrame, key: str = "name") -> DataFrame:
    """Adds media_id and action to folders that are wanted (name): an existing one is reused, only an absent one is made."""
    known = items.groupBy(F.col(key)).agg(F.min("media_id").alias("media_id"))
    return wanted.select(key).distinct().join(known, key, "left").withColumn("action", F.when(F.col("media_id").isNull(), "create").otherwise("reuse"))
