"""Quality of segmentations: confusion, overlaps, step metrics, region quality, boundaries.

All counts are partial sums; boundaries come from one window a direction, so an
image is never gathered in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.storage import made

PAIR_ROWS = 250_000  # pixels of a large table whose neighbours a task counts


def confusion(df: DataFrame, gt: str = "gt", pred: str = "pred", valid: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``by.., gt, pred, n`` over valid pixels."""
    rows = df if valid is None else df.where(valid)
    return rows.groupBy(*by, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by.., class, tp, fp, fn, iou`` from confusion cells; the IoU of an empty union is null."""
    sides = cells.select(*by, "n", F.inline(F.array(
        F.struct(F.col("gt").alias("class"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")),
    )))
    sums = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), (F.sum("p") - F.sum("tp")).alias("fp"), (F.sum("g") - F.sum("tp")).alias("fn"))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return sums.withColumn("iou", F.when(union > 0, F.col("tp") / union))


def summary(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by.., accuracy, miou``: over all valid pixels; the mean over classes with a union, 0 if there are none."""
    iou = class_metrics(cells, by).groupBy(*by).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("miou"))
    acc = cells.groupBy(*by).agg((F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return acc.join(iou, list(by)) if by else acc.crossJoin(F.broadcast(iou))  # one row each


def step_metrics(df: DataFrame, by: tuple[str, ...] = ("image",)) -> DataFrame:
    """Annotated and correct pixels, coverage, precision (0 if nothing is annotated); -1 is not annotated."""
    known = F.col("pred") >= 0
    right = known & (F.col("pred") == F.col("gt"))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_px"), F.count_if(known).alias("annotated_px"), F.count_if(right).alias("correct_px")
    )
    return out.withColumn("coverage", F.col("annotated_px") / F.col("total_px")).withColumn(
        "precision", F.when(F.col("annotated_px") > 0, F.col("correct_px") / F.col("annotated_px")).otherwise(0.0)
    )


def efficiency(df: DataFrame) -> DataFrame:
    """What a step yields for its cost: per scribble, per 1000 pixels of ink, and quality times coverage."""
    c = F.col
    n, ink = F.greatest(c("n_scribbles"), F.lit(1)), c("total_ink_px")
    return df.withColumns({
        "miou_per_scribble": c("miou") / n,
        "miou_per_1kpx": c("miou") / F.greatest(F.lit(1e-6), ink / 1000),
        "correct_px_per_scribble": c("correctly_annotated_px") / n,
        "correct_px_per_px_ink": c("correctly_annotated_px") / F.greatest(F.lit(1e-6), ink),
        "quality_x_coverage": c("miou") * c("coverage"),
    })


def binary_iou(a: Column, b: Column) -> Column:
    """IoU of two masks as an aggregate; 0 on an empty union."""
    inter, union = F.count_if(a & b), F.count_if(a | b)
    return F.when(union > 0, inter / union).otherwise(0.0)


def class_shares(df: DataFrame, cls: str = "gt") -> DataFrame:
    """Share of each class: over all pixels, and mean and population deviation over images, absent ones as zero."""
    counts = df.groupBy("image", F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy("image").agg(F.sum("n").alias("size"))
    each = counts.join(size, "image").withColumn("share", F.col("n") / F.col("size"))
    whole = size.agg(F.count(F.lit(1)).alias("images"), F.sum("size").alias("total"))
    sums = each.groupBy("class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("present_images"), F.sum("share").alias("s1"), F.sum(F.col("share") * F.col("share")).alias("s2")
    )
    c = F.col
    mean = c("s1") / c("images")
    return sums.crossJoin(F.broadcast(whole)).select(  # one row
        "class", (c("n") / c("total")).alias("global_share"), mean.alias("mean_share"), F.sqrt(F.greatest(c("s2") / c("images") - mean * mean, F.lit(0.0))).alias("std_share"),
        (c("s1") / c("present_images")).alias("mean_present"), "present_images",
    )


def region_stats(df: DataFrame, channels: tuple[str, ...] = ("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """Mean and population variance of the channels by region."""
    return df.groupBy("image", "sp").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in channels], *[F.var_pop(c).alias(f"var_{c}") for c in channels]
    )


def achievable_accuracy(df: DataFrame) -> DataFrame:
    """``image, asa``: share of pixels right if every region took its commonest class."""
    cells = df.groupBy("image", "sp", "gt").agg(F.count(F.lit(1)).alias("n"))
    tops = cells.groupBy("image", "sp").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return tops.groupBy("image").agg((F.sum("top") / F.sum("n")).alias("asa"))


def undersegmentation(df: DataFrame) -> DataFrame:
    """``image, ue``: sizes of the regions that meet a class beyond its own size, over the image."""
    cells = df.groupBy("image", "sp", "gt").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("image", "sp").agg(F.sum("n").alias("size"))
    met = cells.join(sizes, ["image", "sp"]).groupBy("image").agg(F.sum("size").alias("met"), F.sum("n").alias("n"))
    return met.select("image", ((F.col("met") - F.col("n")) / F.col("n")).alias("ue"))


def edges(df: DataFrame, label: str) -> Column:
    """Whether a pixel differs from any of its four neighbours."""
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    near = [f(label).over(w) for w in (row, col) for f in (F.lag, F.lead)]
    out = F.lit(False)
    for other in near:
        out = out | F.coalesce(other != F.col(label), F.lit(False))
    return out


def compactness(df: DataFrame) -> DataFrame:
    """``image, compactness``: mean over regions of min(1, 4 pi A / P^2), P the boundary pixels; regions without any left out."""
    marked = df.withColumn("edge", edges(df, "sp"))
    shape = marked.groupBy("image", "sp").agg(F.count(F.lit(1)).alias("a"), F.count_if("edge").alias("p")).where("p > 0")
    return shape.groupBy("image").agg(F.avg(F.least(F.lit(1.0), 4 * math.pi * F.col("a") / (F.col("p") * F.col("p")))).alias("compactness"))


def boundary_recall(df: DataFrame, tolerance: int = 2) -> DataFrame:
    """``image, recall``: class boundary pixels within the tolerance of a region boundary; 1 if there is none.

    The near places of a pixel are (2t+1)^2 equal keys, so the join stays an equality join.
    """
    m = df.withColumn("ge", edges(df, "gt")).withColumn("se", edges(df, "sp"))
    shifts = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-tolerance, tolerance + 1) for b in range(-tolerance, tolerance + 1)])
    near = m.where("se").select("image", F.col("x").alias("sx"), F.col("y").alias("sy"), F.inline(shifts)).select(
        "image", (F.col("sx") + F.col("dx")).alias("x"), (F.col("sy") + F.col("dy")).alias("y")
    ).distinct().withColumn("hit", F.lit(1))
    hits = m.where("ge").join(near, ["image", "x", "y"], "left").groupBy("image").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return df.select("image").distinct().join(hits, "image", "left").select("image", F.coalesce("r", F.lit(1.0)).alias("recall"))


def adjacency(df: DataFrame, label: str = "sp") -> DataFrame:
    """``image, u, v, w``: neighbouring labels, u below v, with the length of their common boundary.

    A written table is read once for each direction, by tasks of about ``PAIR_ROWS``
    pixels if it is large: counts of pairs that hardly repeat fill a task's memory.
    """
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    if made(df):
        tasks, usual = df.count() // PAIR_ROWS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = lambda axis: df.repartition(tasks, "image", axis) if tasks > usual else df
        right, below = (placed(axis).select("image", F.col(label).alias("a"), F.lead(label).over(w).alias("b")) for axis, w in (("y", row), ("x", col)))
        pairs = right.unionAll(below).where("a <> b")
    else:
        near = df.select("image", F.col(label).alias("a"), F.lead(label).over(row).alias("right"), F.lead(label).over(col).alias("below"))
        pairs = near.select("image", "a", F.explode(F.array("right", "below")).alias("b")).where("a <> b")
    return pairs.groupBy("image", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count(F.lit(1)).alias("w"))


def mean_over_images(rows: DataFrame, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``by.., n_images`` and the mean of each metric over images, null and NaN left out."""
    means = [F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics]
    return rows.groupBy(*by).agg(F.count_distinct("image").alias("n_images"), *means)
