"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where unset, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="prismal-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, written: list[str] | None = None) -> DataFrame:
    """``df`` written where all executors can read it, and read from there; its path is added to ``written``."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/audit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, written: list[str]) -> None:
    """Remove tables that ``stored`` wrote and empty the list."""
    while written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
