"""Written intermediate tables in the folder that driver and executors share.

A table that only one function reads is deleted by that function (``Scratch``, ``discard``). What a returned
DataFrame still reads stays in ``spark.checkpoint.dir``, for whoever owns that folder to empty after the job; the
folder that a local session without that setting gets is deleted when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it, as in tests, gets a folder of its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        folder = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own.append("file://" + folder)
    return _own[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/codeloom/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends, lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that no plan reads any more."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def rows_of(df: DataFrame) -> int:
    """The number of rows, which a table of ``Scratch`` knows without looking."""
    known = getattr(df, "written_rows", None)
    return df.count() if known is None else known


class Scratch:
    """Written tables of one computation, deleted together at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_path(spark, "scratch")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back; rows are counted on the way, for ``rows_of``."""
        path, counted = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}", Observation()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.written_rows = counted.get["rows"]
        return out

    def clear(self) -> None:
        _delete(self.spark, self.folder)
