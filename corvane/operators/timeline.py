"""Timelines of dialogue: gaps, cumulative clock, chapter markers. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_MS, CHARS_PER_MINUTE = 350, 260


def estimated_ms(text: Column, chars_per_minute: int = CHARS_PER_MINUTE) -> Column:
    return F.floor(F.length(text) * F.lit(60_000) / F.lit(chars_per_minute)).cast("long")


def timeline(segments: DataFrame, gap_ms: int = GAP_MS, speaker_gap_ms: int | None = None, offset_ms: int = 0) -> DataFrame:
    """Adds gap_ms, start_ms, end_ms to segments (episode, line_no, speaker, duration_ms; optional pause_after_ms, pause_before_ms).

    A line's gap is the previous line's own pause if it has one, else that between speakers or the
    plain one, at least its own pause before; gaps up to 10 ms are none. The first line has no gap.
    """
    speaker_gap_ms = round(gap_ms * 1.8) if speaker_gap_ms is None else speaker_gap_ms
    by_line = W.partitionBy("episode").orderBy("line_no")
    zero = F.lit(0).cast("long")
    pause = lambda c: F.coalesce(F.col(c).cast("long"), zero) if c in segments.columns else zero
    explicit, before = F.lag(pause("pause_after_ms")).over(by_line), pause("pause_before_ms")
    change = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_line))
    base = F.when(explicit != 0, explicit).when(change, F.lit(speaker_gap_ms).cast("long")).otherwise(F.lit(gap_ms).cast("long"))
    gap = F.when(F.row_number().over(by_line) == 1, zero).otherwise(F.greatest(base, before))
    sized = segments.withColumn("gap_ms", F.when(gap > 10, gap).otherwise(zero))
    end = F.sum(F.col("gap_ms") + F.col("duration_ms")).over(by_line.rowsBetween(W.unboundedPreceding, 0)) + offset_ms
    return sized.withColumn("end_ms", end.cast("long")).withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def chapter_markers(lines: DataFrame) -> DataFrame:
    """episode, seq, title, start_ms, end_ms from a timeline with a chapter column; each labelled line starts one."""
    total = F.max("end_ms").over(W.partitionBy("episode"))
    marked = lines.withColumn("total_ms", total).filter(F.trim(F.col("chapter")) != "")
    order = W.partitionBy("episode").orderBy("line_no")
    return marked.select("episode", F.row_number().over(order).alias("seq"), F.col("chapter").alias("title"), "start_ms", F.coalesce(F.lead("start_ms").over(order), F.col("total_ms")).alias("end_ms"))


def chapter_in_force(lines: DataFrame) -> DataFrame:
    order = W.partitionBy("episode").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("in_chapter", F.last(F.when(F.trim(F.col("chapter")) != "", F.col("chapter")), ignorenulls=True).over(order))


def speaker_runs(lines: DataFrame, most_ms: int = 90_000) -> DataFrame:
    """Stretches of one speaker: episode, run, speaker, first_line, n_lines, run_ms, too_long."""
    order = W.partitionBy("episode").orderBy("line_no")
    change = F.when(~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) | (F.row_number().over(order) == 1), 1).otherwise(0)
    runs = lines.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("episode", "run").agg(F.first("speaker").alias("speaker"), F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.sum("duration_ms").alias("run_ms"))
    return out.withColumn("too_long", F.col("run_ms") > most_ms)
