"""Shared helpers: positional column picking, scratch tables, Arrow batch limits.

Scratch tables live under ``spark.checkpoint.dir`` or the context's checkpoint
directory, a folder that all executors and the driver share. Only where neither
is set and the master is local, as in tests, is a temporary folder used. They
replace lineage: a lost executor never forces the text scans before them to run
again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``alias=column`` by exact name and position.

    Extra columns never matter, even when they are named like an output column
    or differ from a wanted one only in case.
    """
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_{names.index(c)}").alias(a) for a, c in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables; an error where there is none on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="boardflow-")
    return _LOCAL[app]


class Scratch:
    """Tables of one operator run in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(_remove, spark, self.base)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it reread, cut off from its lineage."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.scratch_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` returned and that nothing reads any more."""
        _remove(self.spark, df.scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder: by Spark's file system, or a local one after the session has ended."""
    if spark.sparkContext._jsc is None:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(unquote(urlparse(path).path), ignore_errors=True)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker holds at once: documents can be very long.

    Plans are lazy, so the session's limits stay; they are only ever lowered.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        found = str(spark.conf.get(key, None))
        if not found.isdigit() or not 0 < int(found) <= most:
            spark.conf.set(key, str(most))


def power_of_two(n: float) -> int:
    """Exponent of the smallest power of two that is at least ``n``."""
    return max(0, (max(1, int(-(-n // 1))) - 1).bit_length())
