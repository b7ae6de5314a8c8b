"""Exact top-k inner product search over norm-sorted blocks.

Vectors are sorted by descending length into blocks. Each query meets the block of the longest
vectors first, which gives it a k-th best score to beat; then only blocks whose longest vector can
still reach that score by Cauchy-Schwarz. Inside a block, vectors go by descending length in
stripes, an SVD rotation puts most of the inner product into the first coordinates, and a pair's
partial sum plus the product of its residual lengths bounds its score; only pairs whose bound
reaches the query's k-th best are computed in full, in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch

SCALE, K = 1024, 10
#: Vectors of a block, queries of a chunk, vectors of a stripe; the widest vectors that are rotated.
BLOCK, CHUNK, STRIPE, ROTATED = 4096, 1024, 512, 512
NO_ID = np.iinfo(np.int64).max


def quantize(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, norm, e (whole numbers as doubles, packed) of the vectors without null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
            whole = np.floor(scale * flat)
            parts = [whole[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905
            yield pa.RecordBatch.from_arrays([ids, pa.array([float(np.sqrt(p @ p)) for p in parts], pa.float64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["vec_id", "norm", "e"])

    v = F.col("v")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(sound).mapInArrow(run, "vec_id long, norm double, e binary")


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the whole table, strongest first, from its second moments (width x width numbers)."""
    if not 1 < width <= ROTATED:
        return np.eye(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0).to_pylist(), width)
            x /= max(1.0, float(np.abs(x).max(initial=0)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    cells = vectors.select("e").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros(width * width)
    for r in cells:
        moments[r["cell"]] = r["v"]
    return np.linalg.eigh(moments.reshape(width, width))[1][:, ::-1].copy()


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Shorter vectors are filled up with zeros."""
    out = np.zeros((len(packed), width))
    for i, b in enumerate(packed):
        x = np.frombuffer(b, np.float64)
        out[i, : len(x)] = x
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of whole numbers, exact; object dtype where doubles can't hold them."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)], object)


def search(q: np.ndarray, q_uid: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, uid: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, vector rows, scores): the k best of each query in this block that reach its floor."""
    norms, q_norm = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
    order = np.argsort(-norms, kind="stable")
    x, ids, uid, norms = x[order], ids[order], uid[order], norms[order]
    head = max(1, x.shape[1] // 4)
    xr, qr = x @ turn, q @ turn
    x_head, q_head = xr[:, :head], qr[:, :head]
    x_rest, q_rest = (np.sqrt(np.maximum(0, n * n - np.einsum("ij,ij->i", h, h))) for n, h in ((norms, x_head), (q_norm, q_head)))
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    least = floor.copy()
    for lo in range(0, len(x), STRIPE):
        hi = min(lo + STRIPE, len(x))
        slack = 1e-9 * q_norm * norms[lo] + 1e-6
        active = np.flatnonzero(q_norm * norms[lo] + slack >= least)
        if not len(active):
            break  # all that follow are shorter
        bound = q_head[active] @ x_head[lo:hi].T + np.outer(q_rest[active], x_rest[lo:hi])
        rows, cols = np.nonzero((bound + slack[active, None] >= least[active, None]) & (q_uid[active, None] != uid[None, lo:hi]))
        if not len(rows):
            continue
        scores = exact_scores(q[active[rows]], x[lo + cols])
        starts = np.searchsorted(rows, np.arange(len(active) + 1))
        for r, i in enumerate(active):
            a, b = starts[r], starts[r + 1]
            if a == b:
                continue
            at, own = np.concatenate([best[i][0], lo + cols[a:b]]), np.concatenate([best[i][1], scores[a:b]])
            keep = np.lexsort((ids[at], -own))[:k] if own.dtype != object else np.array(sorted(range(len(own)), key=lambda j: (-own[j], ids[at[j]]))[:k])
            best[i] = at[keep], own[keep]
            if len(keep) == k:
                least[i] = max(least[i], float(own[keep[-1]]))
    for i, (at, own) in enumerate(best):
        if len(at):
            yield i, order[at], own


def _meet(queries: DataFrame, blocks: DataFrame, turn: np.ndarray, width: int, k: int) -> DataFrame:
    """Both sides have (chunk, block); each such pair is one task of bounded size."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(left) and len(right):
            q, x = matrix(left["e"].to_pylist(), width), matrix(right["e"].to_pylist(), width)
            ids = right["vec_id"].fill_null(NO_ID).to_numpy()
            for i, at, own in search(q, left["uid"].to_numpy(), left["floor"].to_numpy(), x, ids, right["uid"].to_numpy(), turn, k):
                out[0] += [left["uid"][i].as_py()] * len(at)
                out[1] += [left["vec_id"][i].as_py()] * len(at)
                out[2] += [right["vec_id"][int(j)].as_py() for j in at]
                out[3] += [min(max(int(s), -(2**63)), 2**63 - 1) for s in own]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["uid", "query_id", "vec_id", "score"])

    keys = ["chunk", "block"]
    return queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, "uid long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products with all other rows.

    is_query: a condition on the column vec_id. Ties go to the smaller id (null ids last). Vectors
    null or holding null or non-finite components take no part; shorter vectors count as filled up
    with zeros. Rows that repeat an id are rows of their own: only the query's own row is left out.
    Scores beyond 64 bits are ordered as the nearest long. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = quantize(vectors, id_col, vector_col, scale).withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.save(rows, "vectors")
    n, size, n_queries = rows.agg(F.count("*"), F.coalesce(F.max(F.octet_length("e")), F.lit(0)), F.count(F.when(is_query, 1))).first()
    width = max(1, size // 8)
    turn = rotation(rows, width)
    blocks = max(1, math.ceil(n / BLOCK))
    by_length = [F.desc("norm"), F.asc("vec_id"), F.asc("uid")]
    sorted_rows = rows.repartitionByRange(blocks, *by_length).withColumn("block", F.spark_partition_id())
    sorted_rows = scratch.save(sorted_rows, "sorted")
    longest = sorted_rows.groupBy("block").agg(F.max("norm").alias("longest"))
    first = longest.agg(F.min("block")).first()[0] or 0
    chunks = max(1, math.ceil(n_queries / CHUNK))
    each_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    asked = rows.filter(is_query).withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
    lowest = F.lit(float("-inf")).alias("floor")
    seeds = _meet(asked.select("*", F.lit(first).alias("block"), lowest), sorted_rows.filter(F.col("block") == first).withColumn("chunk", each_chunk), turn, width, k)
    seeds = scratch.save(seeds, "seeds")
    # the k-th best so far, if there are k
    floors = seeds.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    asked = asked.join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    asked = scratch.save(asked, "asked")
    # the length a vector needs to reach a query's floor; what a chunk needs is its least
    need = F.when(F.col("floor") <= 0, F.lit(0.0)).otherwise(F.col("floor") / F.col("norm") * (1 - 1e-9))
    needs = asked.groupBy("chunk").agg(F.min(F.coalesce(need, F.lit(0.0))).alias("need"))
    last = longest.agg(F.max("block")).first()[0] or 0
    # a query chunk against the blocks that it needs: the blocked grid of a stated query set
    pairs = needs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last)))).filter(F.col("block") != first).join(longest, "block").filter("longest >= need").select("chunk", "block")
    pairs = scratch.save(pairs, "pairs")
    others = _meet(asked.join(pairs, "chunk"), scratch.again(sorted_rows).join(scratch.again(pairs), "block"), turn, width, k)
    order = W.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = seeds.unionByName(others).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
