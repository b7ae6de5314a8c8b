"""What the operators of this subpackage share: the shared folder and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.scratch import small_batches


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests, a laptop) is a local one made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder: each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_folder(spark)}/corvane/{label}-{uuid.uuid4().hex}"
        self._made = 0

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.base}/{self._made:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._read(path, df.schema)

    def _read(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._corvane_path = path
        return out

    def again(self, table: DataFrame) -> DataFrame:
        """The same table read once more, so that it can be joined with itself."""
        return self._read(table._corvane_path, table.schema)

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            path = table if isinstance(table, str) else table._corvane_path
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_ids(df: DataFrame, ids: DataFrame, on: str, n_ids: int, how: str, bound: int = 2_000_000) -> DataFrame:
    """Joins with a table of ids: it is broadcast only if its counted rows keep the bound, else both sides are shuffled."""
    return df.join(F.broadcast(ids) if n_ids <= bound else ids, on, how)
