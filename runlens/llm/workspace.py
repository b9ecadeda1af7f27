"""Tables written between stages, in the folder that all machines of the cluster share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode without spark.checkpoint.dir, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only local mode has a default: elsewhere a local folder would be lost."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


class Workspace:
    """Cuts lineage with Parquet tables below the shared folder, and drops those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/runlens-{uuid.uuid4().hex}"
        self.n = 0
        self.kept: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again; the path is kept on the returned frame for drop()."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.kept_at = path
        self.kept[path] = kept
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables written by keep() that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.kept.pop(df.kept_at, None)

    def clear(self, *frames: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*[df for path, df in self.kept.items() if path not in {x.kept_at for x in frames}])
        self.release()

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of tables that are written by now; it does so only when the driver's JVM collects its garbage."""
        self.spark.sparkContext._jvm.System.gc()


def without_ascii_case(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_of_id(c: Column) -> Column:
    """crc32 of the id as text, the fold rule of the learned operators; null for a null id."""
    return F.crc32(c.cast("string").cast("binary"))
