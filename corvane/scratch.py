"""Tables that cut the lineage of loops, written to the folder that driver and executors share; Arrow batches of bounded size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """df, written to ``spark.checkpoint.dir``; only a session on one machine that names none gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return df.checkpoint()


#: Bytes of an Arrow batch: whole texts go to Python, so that few long ones are held at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session's Arrow batches hold BATCH_BYTES at most; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
