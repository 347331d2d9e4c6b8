"""Arrow batches of texts, cut to a bounded number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROWS, BYTES = 512, 2 << 20  # of a piece at most; a single longer text is a piece of its own


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``size`` bytes in their column of texts, in order."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + size, "right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it is so small and in so few files that half of them would have nothing to do.

    Only a scan's estimate and its list of files are looked at. Larger tables
    are read where they lie, and no text of theirs is ever moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > part * cores // 2 or len(df.inputFiles()) > cores // 2:
        return df
    return df.repartition(cores)
