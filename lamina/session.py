"""Session defaults and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lamina", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC, for tests and local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.cteRecursionLevelLimit": "10000",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset a temporary one in local mode, and an error on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lamina-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def by_shuffle(df: DataFrame) -> DataFrame:
    """The table with a hint that the next join sorts and merges it, but for one that asks for a broadcast itself.

    Spark broadcasts a table that it takes for small, and it takes a table for as large as its compressed files, or
    as what it was before ``explode``: voxels made from a few MB of balls or runs would be gathered in the driver. The
    hint goes up through selections and sums, not through unions and joins.
    """
    return df.hint("merge")


class Workspace:
    """Tables of one run, in the shared folder, so that a lost executor loses none of them.

    ``keep`` writes a DataFrame and reads it back, which cuts its lineage;
    ``drop`` deletes tables that nothing lazy refers to any more.
    by_shuffle: whether its tables meet others by shuffles alone, as ``by_shuffle`` has them do.
    """

    def __init__(self, spark: SparkSession, name: str, by_shuffle: bool = False):
        self.spark, self.by_shuffle = spark, by_shuffle
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.met(self.spark.read.schema(df.schema).parquet(self.path(name)))

    def met(self, df: DataFrame) -> DataFrame:
        """The table as others of the run meet it."""
        return by_shuffle(df) if self.by_shuffle else df

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        """Deletes all tables of the run; nothing lazy may refer to them any more."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of DataFrames that are gone, which it does when their handles are collected."""
        gc.collect()
        self.spark._jvm.System.gc()
