"""Cutting lineage in loops: a checkpoint in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``; where none is set a local session gets a temporary one, and a
    cluster an error, as its machines would not see each other's files."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A Parquet table of its own in the shared folder: smaller than a checkpoint, and plans know nothing of what made it."""
    return Rounds().put(df)


class Rounds:
    """The table of a loop's last round, in the shared folder; the one before goes when it is written."""

    def __init__(self) -> None:
        self.at: str | None = None

    def put(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        before, self.at = self.at, f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
        df.write.parquet(self.at)
        self._drop(spark, before)
        return spark.read.schema(df.schema).parquet(self.at)

    def end(self, spark: SparkSession) -> None:
        """The last table goes too."""
        self._drop(spark, self.at)
        self.at = None

    def _drop(self, spark: SparkSession, at: str | None) -> None:
        if at:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
