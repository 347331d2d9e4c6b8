"""The logical relations of the engine, projected from general tables.

Where no rasters are at hand, each relation is a projection of one table: pixels
of line items, metric steps of events, region embeddings of vectors, and so on.
Operators take relations, never tables, so real data only needs its own
projection with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.sources.tables import table

GRID_WIDTH = 64
SPAN = 4096  # order keys that are numbered together
BUDGETS = (1, 3, 5, 10, 20, 50, 100)  # fixed values: the interaction budgets of a benchmark


def argmax_class(scores: list[Column]) -> Column:
    """The number of the greatest score, the lowest on a tie."""
    best = F.greatest(*scores)
    out = F.lit(len(scores) - 1)
    for k in range(len(scores) - 2, -1, -1):
        out = F.when(scores[k] == best, k).otherwise(out)
    return out


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """``image, sp, gt, lg0..lg2, pred, valid, lab_l, lab_a, lab_b``."""
    c = F.col
    rows = table(spark, d, "lineitem").select(
        c("l_linenumber").alias("image"), c("l_suppkey").alias("sp"), (c("l_partkey") % 3).cast("int").alias("gt"),
        (c("l_quantity") / 10).alias("lg0"), (c("l_discount") * 50).alias("lg1"), (c("l_tax") * 60).alias("lg2"),
        (c("l_returnflag") != "N").alias("valid"),
        (c("l_extendedprice") / 1000).alias("lab_l"), (c("l_discount") * 100).alias("lab_a"), (c("l_tax") * 100).alias("lab_b"),
    )
    return rows.withColumn("pred", argmax_class([c("lg0"), c("lg1"), c("lg2")]))


def _numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``rn``: numbers from 0 within each ``by``. Spans of the first (numeric) column of the order are sorted apart, so that a group isn't one task."""
    c = F.col
    at = rows.withColumn("span", F.coalesce(F.floor(c(order[0]) / SPAN), F.lit(-(1 << 62))))
    before = Window.partitionBy(by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy(by, "span").agg(F.count(F.lit(1)).alias("n")).select(by, "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = at.withColumn("rn", F.row_number().over(Window.partitionBy(by, "span").orderBy(*order)) - 1)
    return own.join(starts, [by, "span"]).withColumn("rn", (c("rn") + c("start"))).drop("span", "start")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """``image, x, y, sp, gt, pred``: pixels with places; equal rows may change places."""
    return grid_pixels(spark, d).select("image", "x", "y", "sp", "gt", "pred")


def grid_pixels(spark: SparkSession, d: str) -> DataFrame:
    """``image, x, y, sp, gt, pred, lg0..lg2``: as ``grid``, with logits."""
    t = table(spark, d, "lineitem")
    rows = _numbered(t, "l_linenumber", [c for c in t.columns if c != "l_linenumber"])
    c = F.col
    out = rows.select(
        c("l_linenumber").alias("image"), (c("rn") % GRID_WIDTH).cast("int").alias("x"), F.floor(c("rn") / GRID_WIDTH).cast("int").alias("y"),
        c("l_suppkey").alias("sp"), (c("l_partkey") % 3).cast("int").alias("gt"),
        (c("l_quantity") / 10).alias("lg0"), (c("l_discount") * 50).alias("lg1"), (c("l_tax") * 60).alias("lg2"),
    )
    return out.withColumn("pred", argmax_class([c("lg0"), c("lg1"), c("lg2")]))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """``run, step, ink, cls, miou``: the metric log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), (F.row_number().over(w) - 1).alias("step"), F.col("value").alias("ink"), F.col("event_type").alias("cls"),
        (F.col("value") / 500).alias("miou"),
    )


def bench_rows(spark: SparkSession, d: str) -> DataFrame:
    """``event_id, method, budget, status, miou, coverage``: rows of a benchmark."""
    c = F.col
    return table(spark, d, "events").select(
        "event_id", c("event_type").alias("method"), (c("user_id") % 5).cast("int").alias("budget"), c("user_id").alias("image"),
        F.when(c("event_id") % 11 == 0, "failed").otherwise("ok").alias("status"),
        (c("value") / 500).alias("miou"), (c("event_id") % 100 / 100).alias("coverage"),
    )


def region_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``sp, emb, code, cx, cy``: regions with embedding, class and centroid."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sp"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"), F.col("label").alias("code"),
        F.col("embedding")[0].cast("double").alias("cx"), F.col("embedding")[1].cast("double").alias("cy"),
    )


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """``id, x0, x1, y0, y1``: boxes."""
    x, y = F.col("p_size") / 50.0, (F.col("p_retailprice") - 900) / 100.0
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.alias("x0"), (x + 0.02).alias("x1"), y.alias("y0"), (y + 0.02).alias("y1"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """``run_id, path, status, metric``: the run catalog."""
    c = F.col
    folder = (
        F.when(c("o_orderpriority") == "1-URGENT", "/repo/artifacts/sweeps/").when(c("o_orderpriority") == "2-HIGH", "/repo/artifacts/interactive_runs/")
        .when(c("o_orderpriority") == "3-MEDIUM", "/repo/artifacts/case_studies/").when(c("o_orderpriority") == "5-LOW", "/repo/artifacts/debug/smoke_")
        .otherwise("/repo/Other/Smoke_")
    )
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("run_id"), F.concat(folder, F.lit("run_"), c("o_orderkey").cast("string")).alias("path"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("metric")
    )
