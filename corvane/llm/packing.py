"""Best-fit packing of tokenized documents into sequences.

Bulk-synchronous best fit. Documents' pieces and open gaps are kept sorted by size as runs of rank
intervals: a size class and the ranks in it. A round sweeps the largest unplaced class over its
successor gaps: the smallest gap class that holds it takes as many as it has gaps, conflicts inside
a class are settled by rank, the gaps shrink, what is left goes to the next larger gap class, and
only then to new sequences. Since sizes are whole numbers up to the capacity, there are at most
``capacity`` piece classes and as many gap classes, so the sweeps work on that bounded table while
the documents themselves are ranked once, sorted by size, and joined once with their places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Memo, read_ranks
from .shared import Scratch

CAPACITY, END_ID = 1024, 2


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for all pieces; counts: pieces by length.

    Rank r of a run lies in sequence first + r - first rank, at the run's offset.
    """
    places, opened = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: intervals of sequences
    sizes: list[int] = []  # the gap classes, sorted
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # no gap is large enough: open as many sequences as these pieces fill
                fresh = -(-left // (capacity // length))
                gap, first, n = capacity, opened, fresh
                opened += fresh
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    del sizes[at]
            take = min(n, left)
            places.append((length, rank, take, first, capacity - gap))
            for rest, lo, k in ((gap - length, first, take), (gap, first + take, n - take)):
                if k and rest:
                    if rest not in gaps:
                        gaps[rest] = []
                        insort(sizes, rest)
                    gaps[rest].append((lo, k))
            rank, left = rank + take, left - take
    return places


@lru_cache(2)
def _encoders(json_path: str, ranks_path: str, pattern: str) -> tuple[Callable[[str], bytes], Callable[[str], bytes]]:
    """A whole text's ids as little-endian unsigned 32-bit integers: by the vocabulary's ranks, and by the tokenizer file's library."""
    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer

    ranks = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    @lru_cache(1)
    def whole() -> Tokenizer:  # only where a text asks for it
        return Tokenizer.from_file(json_path)

    def by_library(text: str) -> bytes:
        return np.array(whole().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_ranks(text: str) -> bytes:
        try:
            return ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # its regular expressions give up on some ten million white spaces in a row
            return by_library(text)

    return by_ranks, by_library


@lru_cache(2)
def _special(json_path: str) -> tuple[str, ...]:
    import json

    with open(json_path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but for the first."""
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, head if head and s == 0 else capacity) for s in starts]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def tokenize(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document, numbered by length inside their partition (part, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.claim("packing")
        (by_ranks, by_library), special = _encoders(json_path, ranks_path, pattern), _special(json_path)
        part, seen, end = TaskContext.get().partitionId(), {}, end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                x = (by_library if any(s in t for s in special) else by_ranks)(t) + end
                for piece, (start, length) in enumerate(cut(len(x) // 4, capacity)):
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((doc, piece, start, length, zlib.crc32(x[4 * start : 4 * (start + length)]), part, rank))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (part, rank: their number among those of their length in a written partition)."""
    spark = pieces.sparkSession
    parts = pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("piece lengths lie between 1 and the capacity")
    runs = spark.createDataFrame(plan(counts, capacity), "length long, first long, n long, sequence long, offset long")
    # a run for each piece class and gap class it meets: bounded by the capacity, not by the corpus
    ranked = pieces.join(parts.drop("n"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    inside = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("r.n"))
    return ranked.alias("p").join(F.broadcast(runs).alias("r"), inside).select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )


def pack_documents(
    docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row's document.

    A null text is empty: one piece that holds the end id. Documents over the capacity are cut into
    full pieces behind a shorter first one. Ties are settled by place in the table; repeated rows
    are packed each for itself; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(tokenize(docs, json_path, ranks_path, pattern, id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, capacity)
