"""Streaming forms of the incremental steps: each hash is rendered once, each address collected once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def stream_segments(lines: DataFrame, engine: str, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Segments to render of a stream of lines (speaker, voice, text, ts): one for each content hash within the watermark."""
    cleaned = lines.withColumn("text", T.clean_for_speech(F.coalesce("text", F.lit("")))).filter("text <> ''")
    hashed = cleaned.withColumn("hash", T.segment_hash(F.lit(engine), F.col("voice"), F.col("text")))
    return hashed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["hash"])


def stream_collect(found: DataFrame, key: str, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    return found.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def stream_chars(lines: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Characters by speaker and event-time window."""
    return lines.withWatermark(time_col, late).groupBy(F.window(time_col, window), "speaker").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"))
