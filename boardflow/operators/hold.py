"""Cutting lineage: rows that several steps read are worked out once.

They are written as Parquet in a folder that the driver and all executors
share: ``spark.checkpoint.dir``, or else the context's checkpoint directory. A
temporary folder is used only where the master is local. So readers get only
the columns they ask for, sizes are known to the optimizer, and a lost executor
never forces the steps before to run again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="boardflow-")
    return _LOCAL[context.applicationId]


def hold(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there; the files go when the driver ends, or by ``release``."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/held-{uuid.uuid4().hex}"
    atexit.register(remove, spark, at)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.held_at = at
    return out


def release(df: DataFrame) -> None:
    """Delete held rows that nothing reads any more."""
    remove(df.sparkSession, df.held_at)


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(unquote(urlparse(path).path), ignore_errors=True)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sorts both sides and never gathers one in the driver.

    Sizes are estimated from files, which are compressed, and know nothing of
    rows that are exploded to many: of those a broadcast would outgrow the driver.
    """
    return left.join(right.hint("merge"), on, how)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all cores, where few bytes are much work: a small table would else be one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)
