"""Intermediate tables in the folder that all executors share.

Long jobs cut their lineage by writing a Parquet table under
``spark.checkpoint.dir`` and reading it back: a lost executor then costs one
read, never a recomputation of everything before it. The folder is read from
the session; only where none is configured (tests) a local one is used.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The URI under which intermediate tables may be written."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lattice-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Names one job's tables under ``shared_root``."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{job}-{uuid.uuid4().hex[:12]}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark delete the shuffle files of the jobs before."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()
