"""Joins by place and by order: boxes that overlap, points within a radius, the last row before a mark.

None is a nested loop: space is cut into cells, a cell is an equality key, and the
exact predicate follows. Each pair is kept in one cell only, so no removal of
repeats is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOGETHER = 256  # equal boxes that are compared as one


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def box_join(a: DataFrame, b: DataFrame, cell: float, ordered: bool = False) -> DataFrame:
    """Pairs of boxes (``id, x0, x1, y0, y1``) that overlap, borders included: ``a_id, b_id``; with ``ordered`` only those with ``a_id`` below ``b_id``.

    ``cell`` should be near the usual size of a box: then a box has few cells and
    a cell few boxes. A pair is kept in the cell of the low corner of its overlap.
    Equal boxes are compared as one, ``TOGETHER`` of them at most, so the work is
    that of the different boxes and of the pairs found. Boxes with nulls overlap nothing.
    """
    sides = ("x0", "x1", "y0", "y1")

    def spread(df: DataFrame, p: str) -> DataFrame:
        known = df.select("id", *sides).dropna().where("x0 <= x1 AND y0 <= y1")
        part = F.floor((F.row_number().over(Window.partitionBy(*sides).orderBy("id")) - 1) / TOGETHER)
        same = known.withColumn("part", part).groupBy(*sides, "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        named = same.select(*[F.col(c).alias(p + c) for c in ("ids", *sides)])
        return named.withColumn("cx", F.explode(_cells(F.col(p + "x0"), F.col(p + "x1"), cell))).withColumn("cy", F.explode(_cells(F.col(p + "y0"), F.col(p + "y1"), cell)))

    both = spread(a, "a_").join(spread(b, "b_"), ["cx", "cy"]).where("a_x0 <= b_x1 AND a_x1 >= b_x0 AND a_y0 <= b_y1 AND a_y1 >= b_y0")
    own = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    pairs = both.where(own)
    if ordered:
        pairs = pairs.where(F.col("a_ids")[0] < F.element_at("b_ids", -1))
    each = pairs.select(F.explode("a_ids").alias("a_id"), "b_ids").select("a_id", F.explode("b_ids").alias("b_id"))
    return each.where("a_id < b_id") if ordered else each


def radius_join(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (``id, x, y``) at most ``radius`` apart: ``a_id, b_id, dist``; cells as wide as the radius."""
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay")).dropna()
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by_")).dropna()
    near = F.sequence(F.lit(-1), F.lit(1))
    left = left.withColumn("cx", F.explode(F.transform(near, lambda i: F.floor(F.col("ax") / radius) + i))).withColumn(
        "cy", F.explode(F.transform(near, lambda i: F.floor(F.col("ay") / radius) + i))
    )
    right = right.withColumn("cx", F.floor(F.col("bx") / radius)).withColumn("cy", F.floor(F.col("by_") / radius))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by_")) ** 2)
    return left.join(right, ["cx", "cy"]).withColumn("dist", d).where(F.col("dist") <= radius).select("a_id", "b_id", "dist")


def asof_budgets(steps: DataFrame, budgets: list[int], by: str = "run", order: str = "step", values: tuple[str, ...] = ("miou",)) -> DataFrame:
    """For each run and budget the last row with ``order`` at most the budget, else the run's first row.

    One aggregate with a filtered ``max_by`` per budget: no join, no sort, and a
    run of any length is pre-aggregated where it lies.
    """
    row = F.struct(F.col(order), *values)
    picked = steps.groupBy(by).agg(
        F.min(row).alias("first"), *[F.max(F.when(F.col(order) <= b, row)).alias(f"b{b}") for b in budgets]
    )
    each = F.array(*[F.struct(F.lit(b).alias("budget"), F.coalesce(F.col(f"b{b}"), F.col("first")).alias("r")) for b in budgets])
    flat = picked.select(by, F.inline(each))
    return flat.select(by, "budget", F.col(f"r.{order}").alias(order), *[F.col(f"r.{v}").alias(v) for v in values])
