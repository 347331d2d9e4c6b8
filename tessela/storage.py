"""Where intermediate tables live.

Iterative operators cut their lineage by writing a table, never with a local
checkpoint. The folder is the one the cluster names in ``spark.checkpoint.dir``,
which all executors share; only where that is unset (tests, a laptop) a
temporary folder is made and recorded in the session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # else they stay until the driver happens to collect its garbage


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessela-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessela-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path for an intermediate table of this application."""
    return f"{_own(spark)}/{what}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes this application's intermediate tables; results that still read them must have been written."""
    remove(spark, _own(spark))


def write_counted(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write ``df`` as Parquet and return its row count, in one job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def materialise(df: DataFrame, what: str) -> DataFrame:
    """A durable copy of ``df`` in the shared folder, with its lineage cut; what was shuffled for it is removed from the executors' disks."""
    spark = df.sparkSession
    path, before = scratch_path(spark, what), spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def made(df: DataFrame) -> bool:
    """Whether ``df`` is just what ``materialise`` gave."""
    return "_scratch" in vars(df)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*made: DataFrame) -> None:
    """Remove what ``materialise`` wrote for tables that no later plan reads."""
    for df in made:
        remove(df.sparkSession, df._scratch)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Within it, results are made and written; at its end this application's intermediate tables are removed."""
    try:
        yield
    finally:
        clear(spark)
