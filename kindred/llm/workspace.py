"""Tables written between the steps of an operator, in the folder that all machines share."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where that is unset (tests on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = Path(tempfile.gettempdir(), f"kindred-{os.getpid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """Where Python workers write files of a shared folder, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder)) if ":" in folder else (fs.LocalFileSystem(), folder)


def ship(spark: SparkSession) -> None:
    """Lets Python workers that are started from here on import this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if root not in sys.path:
        sys.path.append(root)


class Workspace:
    """A folder of its own below the shared one; tables are dropped as soon as the operator no longer needs them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and returns the written table, which has no lineage to recompute."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """A reliable checkpoint, which Spark's cleaner removes together with the plans that read it."""
        return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, dealt to all cores where its files alone would leave some idle (small tables only)."""
    ship(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
