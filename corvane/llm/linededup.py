"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Lines are named by two 64-bit hashes. Each round sorts the windows of so many lines by the ranks of
their two parts (range partitions, so that a hot line spreads over many tasks) and gives each the
rank of its first row: equal ranks are the suffixes whose longest common prefix has at least that
many lines, an interval of the array, whose first row is the earliest copy. Windows in an interval
of their own leave the array. Doubling ends at the length from which every window has the words
that a run must have; the lengths between the powers of two are two overlapping windows and are
sorted together. So each suffix's longest repeated prefix is known as far as it can matter. The
union of a document's windows with an earlier copy and enough words are its maximal repeated runs;
their lines are deleted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo
from .shared import Scratch, shuffle_partitions

#: Words that a repeated run must have.
MIN_WORDS = 10
#: Rows of a range partition, and the most runs that are broadcast.
PARTITION, MOST_RUNS = 500_000, 1_000_000
#: A line's place (document id, hash of its text, number among its lines with words), and what a window has besides:
#: the words before it and at its end, counted from the document's first, and those of its first and last line.
POS, WORDS = ["did", "th", "ln"], ["before", "until", "first", "last"]
# Letters of scripts without spaces, and about how many make a word.
UNSPACED = [(re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]"), 2), (re.compile("[฀-໿က-႟ក-៿]"), 4)]
BLANK = " \t\r\f\x0b"
NO_ID = -(2**63)


def count_words(line: str) -> int:
    """What Unicode white space parts, one at least; in scripts without spaces, so many letters as make a word on average."""
    spaced = len(line.split())
    if not line.isascii():
        spaced += sum(len(letters.findall(line)) // n for letters, n in UNSPACED)
    return max(1, spaced)


def worded(text: str) -> Iterator[str]:
    return (line for line in text.split("\n") if line.strip(BLANK))


PLACED = ", ".join(f"{c} long" for c in [*POS, "h1", "h2", *WORDS])


def line_positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """POS, h1, h2 (the line's name) and WORDS of each line with words, in order: blank lines don't cut a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        Memo.claim("linededup")
        names = [x.split()[0] for x in PLACED.split(", ")]

        def out(rows: list[tuple], hashes: list[bytes]) -> pa.RecordBatch:
            n = np.array(rows, np.int64).reshape(-1, 5)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            did, th, ln, before, words = n.T
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (did, th, ln, h[:, 0], h[:, 1], before, before + words, words, words)], names)

        for batch in batches:
            rows, hashes = [], []
            for did, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                before = 0
                for ln, line in enumerate(worded(text.as_py())):
                    words = count_words(line)
                    rows.append((did, th, ln, before, words))
                    hashes.append(xxhash.xxh3_128_digest(line.encode()))
                    before += words
                if len(rows) > 20_000:
                    yield out(rows, hashes)
                    rows, hashes = [], []
            yield out(rows, hashes)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text), text).mapInArrow(run, PLACED)


def rank_windows(scratch: Scratch, df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """POS, WORDS, keys, rank, earlier and the place of the first copy (from_did, from_ln) of the rows of df whose keys occur again.

    rank: the row number of the first row with equal keys in the order of keys and POS; earlier:
    whether that is another row. Rows equal in keys and POS are one. The driver sees two rows per
    partition.
    """
    spark = df.sparkSession
    parts = max(shuffle_partitions(spark), math.ceil(df.count() / PARTITION))
    order, columns = [*keys, *POS], [*POS, *WORDS, *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        k = np.stack([table[c].to_numpy() for c in order])
        same = k[:, 1:] == k[:, :-1]
        once = np.ones(k.shape[1], bool)
        once[1:] = ~same.all(0)  # rows that repeat a document repeat its places
        table, k = table.filter(pa.array(once)), k[:, once]
        n = len(table)
        new = np.ones(n, bool)
        new[1:] = (k[: len(keys), 1:] != k[: len(keys), :-1]).any(0)
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        again = np.bincount(begin, minlength=n)[begin] > 1
        edge = np.zeros(n, np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        own = [table[c].combine_chunks() for c in columns]
        extra = [np.full(n, TaskContext.get().partitionId(), np.int32), np.arange(n), begin, again, begin == begin[-1], edge, k[len(keys)][begin], k[-1][begin]]
        out = pa.table([*own, *map(pa.array, extra)], [*columns, "part", "row", "begin", "again", "tail", "edge", "from_did", "from_ln"])
        yield from out.to_batches(max_chunksize=20_000)

    schema = ", ".join(f"{c} long" for c in columns) + ", part int, row long, begin long, again boolean, tail boolean, edge int, from_did long, from_ln long"
    ordered = df.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = scratch.save(ordered.mapInArrow(run, schema), f"sorted-{name}")
    edges = sorted(rows.filter("edge > 0").select(*keys, "part", "row", "begin", "edge", "from_did", "from_ln").collect(), key=lambda r: (r["part"], r["row"]))
    firsts, lasts = {r["part"]: r for r in edges if r["edge"] & 1}, [r for r in edges if r["edge"] & 2]
    value = lambda r: [r[c] for c in keys]
    table, offset, before = [], 0, (None, None)
    for i, last in enumerate(lasts):
        first = firsts[last["part"]]
        # the rank and first place of an interval that began in an earlier partition
        carried = before[1] if before[0] == value(first) else None
        follows = i + 1 < len(lasts) and value(last) == value(firsts[lasts[i + 1]["part"]])
        table.append((last["part"], offset, *(carried or (None, None, None)), follows))
        own = (offset + last["begin"], last["from_did"], last["from_ln"])
        before = value(last), carried if carried and last["begin"] == 0 else own
        offset += last["row"] + 1
    offsets = spark.createDataFrame(table, "part int, offset long, carried long, did0 long, ln0 long, follows boolean")  # a row per partition
    carried = (F.col("begin") == 0) & F.col("carried").isNotNull()
    ranked = rows.join(F.broadcast(offsets), "part").filter(F.col("again") | carried | (F.col("tail") & F.col("follows")))
    of = lambda there, here: F.when(carried, F.col(there)).otherwise(here)
    ranked = ranked.select(
        *POS, *WORDS, *keys, of("carried", F.col("offset") + F.col("begin")).alias("rank"), (carried | (F.col("row") > F.col("begin"))).alias("earlier"),
        of("did0", F.col("from_did")).alias("from_did"), of("ln0", F.col("from_ln")).alias("from_ln"),
    )
    out = scratch.save(ranked, name)
    scratch.drop(rows)
    return out


def joined(level: DataFrame, shift: int) -> DataFrame:
    """Windows of each row's and of that ``shift`` lines further on: POS, WORDS, r1 and r2, the parts' ranks."""
    later = W.partitionBy("did", "th").orderBy("ln").rangeBetween(shift, shift)
    then = {c: F.max(c).over(later).alias(f"then_{c}") for c in ("rank", "until", "last")}
    both = level.select(*POS, *WORDS, "rank", *then.values()).filter("then_rank is not null")
    return both.select(*POS, "before", F.col("then_until").alias("until"), "first", F.col("then_last").alias("last"), F.col("rank").alias("r1"), F.col("then_rank").alias("r2"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """did, th, runs: the maximal repeated runs of each document that has any, in order.

    did and th name a document: its id (the least long for null) and its text's hash. A run has its first line and
    its length, counted among the lines with words, and the place of the first copy of its first
    window (first_doc, first_line).
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = scratch.save(line_positions(docs, id_col, text_col), "lines")
    words = F.col("until") - F.col("before")
    # enough words, and too few without one of the ends: a longer window adds nothing to its parts
    counts = (words >= min_words) & ((words - F.col("first") < min_words) | (words - F.col("last") < min_words))
    marks = lambda ranked, size: ranked.filter("earlier").filter(counts).select("did", "th", "ln", size.cast("long").alias("lines"), "from_did", "from_ln")
    span, found, between, used = 1, [], [], [lines]
    level = rank_windows(scratch, lines, ["h1", "h2"], "level-1")
    while True:
        used.append(level)
        found.append(marks(scratch.again(level), F.lit(span)))
        between += [joined(scratch.again(level), n - span).filter(counts).withColumn("n", F.lit(n).cast("long")) for n in range(span + 1, min(2 * span, min_words + 1))]
        if 2 * span > min_words or level.limit(1).count() == 0:
            break
        span *= 2
        doubled = scratch.save(joined(scratch.again(level), span // 2), f"doubled-{span}")
        level = rank_windows(scratch, doubled, ["r1", "r2"], f"level-{span}")
        scratch.drop(doubled)
    if between:
        windows = scratch.save(reduce(DataFrame.unionByName, between), "between")
        ranked = rank_windows(scratch, windows, ["n", "r1", "r2"], "level-between")
        found.append(marks(ranked, F.col("n")))
        used += [windows, ranked]
    each = F.sort_array(F.collect_list(F.struct("ln", "lines", "from_did", "from_ln")))  # a document's windows are at most its lines times min_words
    runs = reduce(DataFrame.unionByName, found).groupBy("did", "th").agg(_merged(each).alias("runs"))
    runs = scratch.save(runs, "runs")
    scratch.drop(*used)
    return runs


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("line", "lines", "first_doc", "first_line")]))


def _merged(windows):
    @F.pandas_udf(RUNS)
    def merged(each: pd.Series) -> pd.Series:
        out = []
        for windows in each:
            runs: list[list[int]] = []
            for w in windows:
                if runs and w["ln"] <= runs[-1][0] + runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], w["ln"] + w["lines"] - runs[-1][0])
                else:
                    runs.append([w["ln"], w["lines"], w["from_did"], w["from_ln"]])
            out.append([dict(zip(RUNS.elementType.names, r, strict=True)) for r in runs])
        return pd.Series(out)

    return merged(windows)


OUT = ["n_lines", "n_deleted", "runs"]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs with text_col without later copies of repeated line runs, and n_lines, n_deleted and runs (see repeated_runs).

    A line goes if it lies in consecutive lines that have min_words words together (see count_words)
    and occur earlier in the order of (id, hash of the text, line). Lines are compared as they are;
    blank ones don't count and go with the line before them. Null and empty texts stay as they are.
    Rows equal in id and text are one document and get one result; rows with a null id come first.
    Other columns stay, but those named like the three new ones, which are replaced. An empty table
    stays empty. Whole texts are read, however long; a batch of texts is held at a time.
    drop_emptied: rows all of whose lines with words are deleted go.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words)
    n_runs = runs.agg(F.coalesce(F.sum(F.size("runs") + 1), F.lit(0))).first()[0]
    text = F.col(f"row.`{text_col}`")
    keyed = docs.select(F.struct("*").alias("row")).withColumns({"did": F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(NO_ID)), "th": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))})
    both = keyed.join(F.broadcast(runs) if n_runs <= MOST_RUNS else runs, ["did", "th"], "left")
    deleted = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["lines"]), F.lit(0))
    rest = [c for c in docs.columns if c not in OUT]
    out = both.select(
        *(F.col(f"row.`{c}`").alias(c) for c in rest if c != text_col), F.when(F.col("runs").isNull(), text).otherwise(_without(text, F.col("runs"))).alias(text_col),
        F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"), deleted.cast("int").alias("n_deleted"),
        F.coalesce("runs", F.array().cast(RUNS)).alias("runs"),
    ).select(*rest, *OUT)
    return out.filter(~((F.col("n_deleted") > 0) & F.coalesce(~F.col(text_col).rlike(r"\S"), F.lit(False)))) if drop_emptied else out


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, runs: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(texts, runs, strict=True):
        if text is None or own is None or not len(own):
            out.append(text)
            continue
        ranges = [(r["line"], r["line"] + r["lines"]) for r in own]
        keep, went, ln, at = [], False, 0, 0
        for line in text.split("\n"):
            if line.strip(BLANK):
                while at < len(ranges) and ln >= ranges[at][1]:
                    at += 1
                went = at < len(ranges) and ln >= ranges[at][0]
                ln += 1
            if not went:
                keep.append(line)
        out.append("\n".join(keep))
    return pd.Series(out, dtype=object)


# a filter on its result stays behind it: pushed down, it would call it once more, in a second worker for each task
_without = _without.asNondeterministic()
