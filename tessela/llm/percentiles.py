"""Percentiles of very large columns from mergeable counts in logarithmic buckets.

A value v falls into the signed bucket ceil(log |v| / log g), g = (1+e)/(1-e).
All values of a bucket lie within the relative error e of its representative, so
the representative of the bucket that holds the wanted rank is within e of the
value of that rank, however many tables were added together. Sketches are
ordinary tables of counts: adding days or partitions is adding counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.005  # greatest relative error of a percentile
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
_LEAST = 1e-300  # magnitudes below count as zero


def shift(error: float) -> int:
    """What is added to a bucket's number so that it stays positive; then the sign can carry the value's sign.

    The least power of two, from 2^20 on, beyond the number of any finite value.
    An error so small that numbers wouldn't fit is a ValueError.
    """
    if not 1e-6 <= error < 1:
        raise ValueError("the relative error must be from 1e-6 to below 1")
    return 1 << max(20, math.ceil(math.log2(711 / math.log((1 + error) / (1 - error)))))


def bucket(value: Column, error: float = ERROR) -> Column:
    """The signed bucket of a number, in the order of the values; null for null and NaN. Infinities have buckets of their own."""
    width, up = math.log((1 + error) / (1 - error)), shift(error)
    size = F.abs(value)
    number = F.when(size == float("inf"), F.lit(2 * up)).otherwise(F.ceil(F.log(size) / F.lit(width)).cast("int") + up)
    signed = F.when(size < _LEAST, F.lit(0)).otherwise(F.signum(value).cast("int") * number)
    return F.when(value.isNotNull() & ~F.isnan(value), signed)


def bucket_value(number: Column, error: float = ERROR) -> Column:
    """The representative of a bucket, within the relative error of each of its values."""
    g, up = (1 + error) / (1 - error), shift(error)
    size = F.when(F.abs(number) == 2 * up, F.lit(float("inf"))).otherwise(F.pow(F.lit(g), F.abs(number) - up) * F.lit(2 / (g + 1)))
    return F.when(number == 0, F.lit(0.0)).otherwise(F.signum(number.cast("double")) * size)


def sketch(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], error: float = ERROR) -> DataFrame:
    """``groups.., metric, bucket, n``: the counts of the buckets. Null and NaN are no values.

    Partitions count before the shuffle, so what moves is as large as the
    buckets in use, whatever share of the rows a group has.
    """
    each = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m), error).alias("bucket")) for m in metrics])
    rows = df.select(*groups, F.inline(each)).where("bucket IS NOT NULL")
    return rows.groupBy(*groups, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches added together over all columns but ``groups``."""
    return sketches.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def column(quantile: float) -> str:
    """The name of a quantile's column: p50, p99_9."""
    return "p" + f"{quantile * 100:g}".replace(".", "_")


def percentiles(sketches: DataFrame, groups: Sequence[str], quantiles: Sequence[float] = QUANTILES, error: float = ERROR) -> DataFrame:
    """``groups.., metric, n_values, p50..``: for each quantile q the value of rank max(1, ceil(q n)), within ``error``."""
    by = [*groups, "metric"]
    w = Window.partitionBy(*by)
    run = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total")))
    picked = run.groupBy(*by).agg(
        F.max("total").alias("n_values"), *[F.min(F.when(F.col("upto") >= at(q), F.col("bucket"))).alias(column(q)) for q in quantiles]
    )
    return picked.select(*by, "n_values", *[bucket_value(F.col(column(q)), error).alias(column(q)) for q in quantiles])


def step_sketch(steps: DataFrame, cases: DataFrame, error: float = ERROR) -> DataFrame:
    """Daily sketches of ``miou`` and ``coverage`` by method.

    ``cases`` has one row ``case_id, method`` per case; steps of others don't
    count. A ``metric_id`` counts once however often it was delivered; rows
    without one can't be told to be repeats and count each. Values are put in
    their buckets before the repeats are removed, so only small numbers move.
    """
    small = steps.select(
        "metric_id", "case_id", F.to_date("logged_at").alias("day"), bucket(F.col("miou"), error).alias("miou"), bucket(F.col("coverage"), error).alias("coverage")
    ).where("miou IS NOT NULL OR coverage IS NOT NULL")
    once = small.where("metric_id IS NOT NULL").dropDuplicates(["metric_id"]).unionByName(small.where("metric_id IS NULL"))
    rows = once.join(cases.select("case_id", "method"), "case_id")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("bucket")) for m in ("miou", "coverage")])
    named = rows.select("method", "day", F.inline(each)).where("bucket IS NOT NULL")
    return named.groupBy("method", "day", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))
