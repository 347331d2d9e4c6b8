"""Reports and tables as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(path: str, *parts: DataFrame, sort_columns: bool = False, files: int | None = None) -> list[str]:
    """The rows of all parts as CSV with header; columns in the order first seen, or sorted. Returns them.

    ``files=1`` is meant for reports; large tables keep their partitions.
    """
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    names = sorted(names) if sort_columns else names
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*names)
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return names


def write_json(path: str, rows: DataFrame, compression: str = "gzip") -> None:
    """Rows as JSON lines; null fields are left out."""
    rows.write.mode("overwrite").option("compression", compression).json(path)


def write_text(path: str, lines: DataFrame, order: str = "line_no") -> None:
    """A report's lines in their order, in one file."""
    lines.orderBy(order).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_pixels(path: str, pixels: DataFrame) -> None:
    """A cache of pixel relations, one folder an image, sorted by region within a file."""
    pixels.repartition("image").sortWithinPartitions("image", "sp").write.mode("overwrite").partitionBy("image").parquet(path)


def before_after(before: DataFrame, after: DataFrame, key: str, metrics: tuple[str, ...]) -> DataFrame:
    """``key, metric, before, after, delta``: two summaries side by side."""
    each = lambda df, n: df.select(key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in metrics])))
    return each(before, "before").join(each(after, "after"), [key, "metric"], "full").withColumn("delta", F.col("after") - F.col("before"))


def study_summary(trials: DataFrame, score: str = "score") -> DataFrame:
    """``study, n_trials, best_trial, best_score``: the best of each study, the first on a tie; null and NaN don't win."""
    good = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(float("-inf")))
    best = F.max(F.struct(good.alias("s"), (-F.col("trial")).alias("t")))
    return trials.groupBy("study").agg(F.count(F.lit(1)).alias("n_trials"), best.alias("b")).select("study", "n_trials", (-F.col("b.t")).alias("best_trial"), F.when(F.col("b.s") > float("-inf"), F.col("b.s")).alias("best_score"))
