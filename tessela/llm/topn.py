"""Top N items within every group, by partition lower bounds.

Each partition finds its local N-th best item of every group it holds. That is a
lower bound of the group's N-th best, so the greatest bound of all partitions
discards, before anything is shuffled by group, every row that can't be among
the N. What survives is ranked in a window, whose group limit prunes each
partition once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_COMPACT_ROWS = 200_000  # rows gathered in a partition before they are cut to the best again


def _best(cols: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Of the columns gid, a, b, c, d: the n best distinct rows of each gid, best first (greatest a, b, c, d)."""
    gid, a, b, c, d = cols
    order = np.lexsort((-d, -c, -b, -a, gid))
    g, *rest = (x[order] for x in cols)
    if not len(g):
        return [g, *rest]
    again = np.ones(len(g), bool)
    again[0] = False
    for x in (g, *rest):
        again[1:] &= x[1:] == x[:-1]
    g, *rest = (x[~again] for x in (g, *rest))
    first = np.r_[True, g[1:] != g[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    keep = np.arange(len(g)) - start < n
    return [x[keep] for x in (g, *rest)]


def _local_bounds(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = kept = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            rows += batch.num_rows
            if rows > max(_COMPACT_ROWS, 2 * kept):
                held = [_best([np.concatenate(x) for x in zip(*held)], n)]
                rows = kept = len(held[0][0])
        if not rows:
            return
        gid, a, b, c, d = _best([np.concatenate(x) for x in zip(*held)], n)
        last = np.r_[gid[1:] != gid[:-1], True]
        ends = np.flatnonzero(last)
        full = ends[np.diff(np.r_[-1, ends]) == n]
        yield pa.RecordBatch.from_arrays([pa.array(x[full]) for x in (gid, a, b, c, d)], names=["gid", "a", "b", "c", "d"])

    return run


def top_n(steps: DataFrame, cases: DataFrame, n: int = 5) -> DataFrame:
    """``method, label, metric_id, rank, miou, coverage, step`` of the n best steps of each method and label.

    ``cases`` has one row ``case_id, method, label`` per case. Order: ``miou``
    descending, ``coverage`` descending with null and NaN last and equal, ``step``
    ascending, ``metric_id`` ascending, nulls last. Null and NaN ``miou`` aren't
    ranked, steps of unknown cases don't count, and repeats of a ``metric_id`` are
    one step. Null methods and labels are names like any other. Empty tables
    give no rows; other columns are not read.

    Scale: rows carry a number for their group, the least case id of it, so only
    numbers are moved. Steps and cases meet on ``case_id``; the bounds join the
    small case table, so that both passes use the same exchange of the steps, and
    adaptive execution splits a hot case. A group of any size leaves at most its
    rows above the bound.
    """
    names = cases.groupBy("method", "label").agg(F.min("case_id").alias("gid"))
    n_ = names.select(F.col("method").alias("m"), F.col("label").alias("l"), "gid")
    ids = cases.join(n_, cases["method"].eqNullSafe(n_["m"]) & cases["label"].eqNullSafe(n_["l"])).select("case_id", "gid")
    rows = steps.where("miou IS NOT NULL AND NOT isnan(miou)").select(
        "case_id",
        F.col("miou").cast("double").alias("a"),
        F.coalesce(F.when(~F.isnan("coverage"), F.col("coverage")), F.lit(float("-inf"))).cast("double").alias("b"),
        (-F.coalesce(F.col("step").cast("long"), F.lit(2**31))).alias("c"),
        (-F.coalesce(F.col("metric_id").cast("long"), F.lit(2**63 - 1))).alias("d"),
    )
    key = F.struct("a", "b", "c", "d")
    local = rows.join(ids, "case_id").select("gid", "a", "b", "c", "d").mapInArrow(_local_bounds(n), "gid long, a double, b double, c long, d long")
    bounds = local.groupBy(F.col("gid").alias("bgid")).agg(F.max(key).alias("bound"))
    bounded = ids.join(bounds, ids["gid"] == bounds["bgid"], "left").select("case_id", "gid", "bound")
    left = rows.join(bounded, "case_id").where(F.col("bound").isNull() | (key >= F.col("bound"))).select("gid", "a", "b", "c", "d")
    order = [F.col(x).desc() for x in ("a", "b", "c", "d")]
    best = left.withColumn("rank", F.dense_rank().over(Window.partitionBy("gid").orderBy(*order))).where(F.col("rank") <= n).distinct()
    return best.join(names, "gid").select(
        "method", "label", F.when(F.col("d") > -(2**63 - 1), -F.col("d")).alias("metric_id"), "rank", F.col("a").alias("miou"),
        F.when(F.col("b") > float("-inf"), F.col("b")).alias("coverage"), F.when(F.col("c") > -(2**31), -F.col("c")).cast("int").alias("step"),
    )
