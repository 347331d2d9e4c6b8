"""Readers of the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table, a file or a folder of files, under ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole small files as rows ``path``, ``size_bytes``, ``modified_at``, ``content``.

    Spark packs many small files into one task (``spark.sql.files.openCostInBytes``),
    so a listing of millions of files doesn't become millions of tasks.
    """
    raw = spark.read.format("binaryFile").load(pattern)
    return raw.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.decode("content", "UTF-8").alias("content"),
    )
