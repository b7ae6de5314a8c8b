"""Sharding by rendezvous hashing (native: DataFrame functions only).

Each record's key draws one exponential race per shard, ``-ln(u) / weight`` with u from
``xxhash64(key, shard)``; the smallest wins. A shard that is added can only win records for
itself, so no record moves between old shards. Slots inside a shard are gapless: a shard is cut
into hash chunks, each chunk numbers its rows, and the chunks' counts give the offsets; no task
ever holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least chunks that a shard is cut into for numbering, and the rows of a chunk that are aimed at beyond them.
CHUNKS, CHUNK_ROWS = 256, 200_000


def _race(key: Column, shard: int, weight: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("race"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) that wins the key; weights are relative capacities, all above 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    races = [_race(key, s, w) for s, w in enumerate(weights)]
    return (F.least(*races) if len(races) > 1 else races[0])["shard"]


def assign_shards(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
    weights: Sequence[float] | None = None, new_weight: float = 1.0, chunks: int | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    Law ``key``: only the key and the shard weights decide. size is the text's UTF-8 bytes plus 8.
    Null text: 0 bytes, crc32 0. A null key is a key of its own (all such rows share one shard).
    Repeated rows go to one shard with slots of their own. An empty table gives an empty result.
    Only id_col and text_col are read, so other columns can't clash. Whole texts are measured, however
    long. chunks: parts of a shard that are numbered one by one (default: by the number of rows).
    """
    chunks = chunks or max(CHUNKS, -(-docs.count() // (n_shards * CHUNK_ROWS)))
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    key = F.col("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shard = shard_of(key, weights)
    grown = shard_of(key, [*weights, new_weight])
    chunk = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(chunks)).cast("int")
    counts = rows.select(shard.alias("shard"), chunk.alias("chunk")).groupBy("shard", "chunk").count()
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    # n_shards x chunks rows: one for 200,000 rows of the input at most, beyond 256 chunks
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = rows.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        shard.alias("shard"), grown.alias("grown_shard"), chunk.alias("chunk"),
    )
    place = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("place", place.cast("long"))
        .join(F.broadcast(offsets), ["shard", "chunk"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("offset") + F.col("place")).alias("slot"), "grown_shard",
        )
    )
