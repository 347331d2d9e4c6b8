"""Ordered logs of steps and annotations: running costs, stalls, smoothing, state and its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SPAN = 1 << 16  # steps of a run that are ordered together


def _with_before(steps: DataFrame, totals: dict[str, Column], carried: dict[str, Column]) -> tuple[DataFrame, Window]:
    """``steps`` with, for each name, what all spans of its run before its own carry over, and the window within a span.

    A run is cut into spans of ``SPAN`` steps, each ordered by itself; only the
    spans' totals, a few numbers each, are ordered by run. So no run of any
    length is one task. ``totals`` are aggregates of a span (their columns are
    called as in ``carried``), ``carried`` makes one of all before.
    """
    at = steps.withColumn("span", F.floor(F.col("step") / SPAN))
    per = at.groupBy("run", "span").agg(*[c.alias(n) for n, c in totals.items()])
    earlier = Window.partitionBy("run").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("run", "span", *[c.over(earlier).alias(f"before_{n}") for n, c in carried.items()])
    key = lambda df: df.withColumnsRenamed({"run": "of_run", "span": "of_span"})
    b = key(before)
    joined = at.join(b, at["run"].eqNullSafe(b["of_run"]) & at["span"].eqNullSafe(b["of_span"]), "left").drop("of_run", "of_span")
    return joined, Window.partitionBy("run", "span").orderBy("step")


def running_cost(steps: DataFrame) -> DataFrame:
    """Adds ``n_scribbles`` and ``total_ink`` up to each step of its run."""
    at, w = _with_before(steps, {"n": F.count(F.lit(1)), "ink_": F.sum("ink")}, {"n": F.sum("n"), "ink_": F.sum("ink_")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ink = F.coalesce(F.sum("ink").over(upto) + F.coalesce("before_ink_", F.lit(0.0)), F.sum("ink").over(upto), F.col("before_ink_"))
    out = at.withColumns({"n_scribbles": F.count(F.lit(1)).over(upto) + F.coalesce("before_n", F.lit(0)), "total_ink": ink})
    return out.select(*steps.columns, "n_scribbles", "total_ink")


def progress(steps: DataFrame, score: str = "miou") -> DataFrame:
    """Adds ``progress``: whether the score rose over the step before (true at the first, and after a null)."""
    last = F.max(F.struct("step", F.col(score).alias("s")))
    at, w = _with_before(steps, {"last": last}, {"last": F.last("last")})
    before = F.when(F.row_number().over(w) == 1, F.col("before_last.s")).otherwise(F.lag(score).over(w))
    return at.withColumn("progress", F.coalesce(F.col(score) > before, F.lit(True))).select(*steps.columns, "progress")


def stalls(steps: DataFrame) -> DataFrame:
    """Adds ``progress`` and ``stall``: how many steps in a row brought no progress."""
    p = progress(steps)
    at, w = _with_before(p, {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    at = at.withColumn("nth", F.row_number().over(w) + F.coalesce("before_n", F.lit(0)))
    # The last step with progress up to each step: in its span, else in an earlier one; the first step of a run has it.
    marks = at.groupBy("run", "span").agg(F.max(F.when(F.col("progress"), F.col("nth"))).alias("mark"))
    earlier = Window.partitionBy("run").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    m = marks.select(F.col("run").alias("of_run"), F.col("span").alias("of_span"), F.max("mark").over(earlier).alias("before_mark"))
    at = at.join(m, at["run"].eqNullSafe(m["of_run"]) & at["span"].eqNullSafe(m["of_span"]), "left")
    own = F.max(F.when(F.col("progress"), F.col("nth"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stall = (F.col("nth") - F.coalesce(own, F.col("before_mark"))).cast("int")
    return at.withColumn("stall", stall).select(*p.columns, "stall")


def ema(steps: DataFrame, keep: float = 0.9, score: str = "miou") -> DataFrame:
    """``run, ema``: the exponential moving average at a run's end, seeded with its first value.

    Unrolled, it is a weighted sum of the values, so an ordinary aggregate gives
    it: a run of any length is never gathered or sorted.
    """
    weight = F.when(F.col("step") == 0, F.pow(F.lit(keep), F.col("last"))).otherwise((1 - keep) * F.pow(F.lit(keep), F.col("last") - F.col("step")))
    last = steps.groupBy("run").agg(F.max("step").alias("last"))
    return steps.join(last, "run").groupBy("run").agg(F.sum(weight * F.col(score)).alias("ema"))


def last_update(events: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """The last value of each key: an upsert in one aggregate."""
    return events.groupBy(*by).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def undo_last(events: DataFrame, n: int = 1) -> DataFrame:
    """The events of each run without its last n; events of one step go together.

    Each partition keeps n rows a run for the cut, whatever a run's length.
    """
    nth = F.row_number().over(Window.partitionBy("run").orderBy(F.col("step").desc()))
    cut = events.select("run", "step").withColumn("back", nth).where(F.col("back") <= n).groupBy(F.col("run").alias("of_run")).agg(F.min("step").alias("cut"))
    return events.join(cut, events["run"].eqNullSafe(cut["of_run"])).where("step < cut").drop("of_run", "cut")


def snapshot_changes(events: DataFrame) -> DataFrame:
    """``run, step, added, changed``: what each snapshot of a run adds to or changes in the one before.

    ``events``: ``run, step, item, code``. An item is added at its first step and
    changed where its code differs from its last one.
    """
    w = Window.partitionBy("run", "item").orderBy("step")
    marked = events.withColumn("before", F.lag("code").over(w)).withColumn("first", F.row_number().over(w) == 1)
    return marked.groupBy("run", "step").agg(F.count_if("first").alias("added"), F.count_if(~F.col("first") & (F.col("before") != F.col("code"))).alias("changed"))


def signature(code: Column, direct: Column, parents: Column) -> Column:
    """What an annotation is compared by: its code, whether a scribble meets it, and its scribbles in their order."""
    return F.struct(code.alias("code"), F.coalesce(direct, F.lit(True)).alias("direct"), F.coalesce(parents, F.array().cast("array<int>")).alias("parents"))


def build_events(states: DataFrame, scribbles: DataFrame, annotations: DataFrame) -> DataFrame:
    """What each saved state of a run adds to the one before it; one row a state.

    ``states``: ``run, index``; ``scribbles``: ``run, index, sid``;
    ``annotations``: ``run, index, sp, code, direct, parents``. Result: ``run,
    index, prev_step, cur_step, step_delta, exact, new_scribbles, direct_sps,
    propagated_sps``. Steps are numbers of scribbles; a delta is never negative,
    and exact if it is one. An annotation is new where the state before has none
    or another for its superpixel. The first state is compared with nothing.
    Rows delivered twice change nothing; of an annotation's several rows in one
    state the greatest counts. Only one superpixel's or scribble's own rows
    meet in a window.
    """
    order = states.select("run", "index").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy("index")))
    own = scribbles.select("run", "index", "sid").where("sid IS NOT NULL").distinct().join(order, ["run", "index"])
    before = F.lag("nth").over(Window.partitionBy("run", "sid").orderBy("nth"))
    new = own.withColumn("before", before).groupBy("run", "nth").agg(
        F.count(F.lit(1)).alias("cur"), F.array_sort(F.collect_list(F.when(F.col("before").isNull() | (F.col("before") != F.col("nth") - 1), F.col("sid")))).alias("new_scribbles")
    )
    sig = annotations.select("run", "index", "sp", signature(F.col("code"), F.col("direct"), F.col("parents")).alias("s")).where("sp IS NOT NULL")
    at = sig.groupBy("run", "index", "sp").agg(F.max("s").alias("s")).join(order, ["run", "index"])
    w = Window.partitionBy("run", "sp").orderBy("nth")
    same = (F.lag("nth").over(w) == F.col("nth") - 1) & (F.lag("s").over(w) == F.col("s"))
    changed = at.withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same").groupBy("run", "nth").agg(
        F.array_sort(F.collect_list(F.when(F.col("s.direct"), F.col("sp")))).alias("direct_sps"), F.array_sort(F.collect_list(F.when(~F.col("s.direct"), F.col("sp")))).alias("propagated_sps")
    )
    out = order.join(new, ["run", "nth"], "left").join(changed, ["run", "nth"], "left").withColumn("cur", F.coalesce("cur", F.lit(0)))
    prev = F.coalesce(F.lag("cur").over(Window.partitionBy("run").orderBy("nth")), F.lit(0))
    out = out.withColumn("prev", prev)
    none = lambda c, df: F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)[c]))
    return out.select(
        "run", "index", F.col("prev").alias("prev_step"), F.col("cur").alias("cur_step"), F.greatest(F.col("cur") - F.col("prev"), F.lit(0)).alias("step_delta"), (F.col("cur") - F.col("prev") == 1).alias("exact"),
        none("new_scribbles", new).alias("new_scribbles"), none("direct_sps", changed).alias("direct_sps"), none("propagated_sps", changed).alias("propagated_sps"),
    )
