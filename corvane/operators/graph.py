"""Knowledge points: their prerequisites, threads, chunks and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.scratch import settled

#: Rounds whose levels are gathered in one table.
ROUNDS = 16


def dependency_levels(points: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """id, level, place: points (id, weight) behind all they depend on (edges: id, needs), heavier ones first.

    A point's level is the longest path to one without prerequisites; points on or behind a cycle
    have none (null) and come last. Each round peels the points whose prerequisites all have levels;
    what no round peels is on or behind a cycle. With ``most``, deeper levels are null as well.
    """
    known = points.select("id").distinct()
    ends = lambda name: known.select(F.col("id").alias(name))
    rest = settled(edges.select("id", "needs").join(ends("needs"), "needs", "left_semi").join(ends("id"), "id", "left_semi").distinct())
    turn, left, reached = 0, rest.count(), None  # rest: edges to points without a level; a point's level is how many rounds it is in there
    while left and (most is None or turn <= most):
        turn += 1
        waiting = rest.select("id").distinct()
        reached = waiting.withColumn("level", F.lit(turn)) if reached is None else reached.unionByName(waiting.withColumn("level", F.lit(turn)))
        if turn % ROUNDS == 0:
            reached = settled(reached.groupBy("id").agg(F.max("level").alias("level")))
        rest = settled(rest.join(waiting.withColumnRenamed("id", "needs"), "needs", "left_semi"))
        before, left = left, rest.count()
        if left == before:
            break
    levels = known.withColumn("level", F.lit(0))
    if reached is not None:
        deepest = reached.groupBy("id").agg(F.max("level").alias("deepest"))
        endless = rest.select("id").distinct().withColumn("endless", F.lit(True))
        levels = known.join(deepest, "id", "left").join(endless, "id", "left").select("id", F.when(F.col("endless").isNull(), F.coalesce("deepest", F.lit(0))).alias("level"))
    if most is not None:
        levels = levels.withColumn("level", F.when(F.col("level") <= most, F.col("level")))
    return placed(levels.join(points, "id"), [F.asc_nulls_last("level"), F.desc("weight"), F.asc("id")]).select("id", "level", "place")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place: the row number in a total order, by range partitions and their counts, so that no task sees all rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    # a row per partition
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", (before - F.col("_first")).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("place", (F.col("_row") + F.col("_offset") + 1).cast("int")).drop("_part", "_row", "_offset")


def outline_links(outline: DataFrame) -> dict[str, DataFrame]:
    """Edge tables of an outline (knowledge_points, threads): depends_on, thread_kp, kp_chunk."""
    kp = outline.select(F.explode("knowledge_points").alias("k")).select("k.*")
    return {
        "depends_on": kp.select("id", F.explode("depends_on").alias("needs")),
        "kp_chunk": kp.select("id", F.explode("source_chunks").alias("chunk")),
        "thread_kp": outline.select(F.explode("threads").alias("t")).select(F.col("t.name").alias("thread"), F.explode("t.kp_ids").alias("id")),
    }


def episode_load(episodes: DataFrame, points: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """episode, n_points, n_unknown, n_without_evidence, verdict."""
    each = episodes.select(F.col("id").alias("episode"), F.explode("kp_ids").alias("kp"))
    joined = each.join(points.select(F.col("id").alias("kp"), (F.size("evidence") > 0).alias("proven")), "kp", "left")
    n = F.count("*")
    return joined.groupBy("episode").agg(
        n.alias("n_points"), F.count_if(F.col("proven").isNull()).alias("n_unknown"), F.count_if(~F.col("proven")).alias("n_without_evidence"),
        F.when(n > high, "overloaded").when(n < low, "thin").otherwise("fits").alias("verdict"),
    )
