"""Benchmarks, sweeps and catalogs: summaries, rankings, leaderboards, grids, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null for NaN."""
    return F.when(~F.isnan(c), c)


def summarise(rows: DataFrame, by: tuple[str, ...] = ("method", "budget"), metrics: tuple[str, ...] = ("miou", "coverage")) -> DataFrame:
    """Means over rows that are ok, counts of both, and a status: ok if any row is."""
    ok = F.col("status") == "ok"
    out = rows.groupBy(*by).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), *[F.avg(F.when(ok, finite(F.col(m)))).alias(f"mean_{m}") for m in metrics])
    return out.withColumn("status", F.when(F.col("n_ok") > 0, "ok").otherwise("failed"))


def with_mean_row(rows: DataFrame, name: str, metrics: tuple[str, ...], label: str = "MEAN") -> DataFrame:
    """The rows and a last one with the means of the metrics, null and NaN left out."""
    mean = rows.agg(*[F.avg(finite(F.col(m))).alias(m) for m in metrics]).withColumn(name, F.lit(label))
    return rows.select(name, *metrics).unionByName(mean.select(name, *metrics))


def leaderboard(summary: DataFrame, budget: int | None = None, score: str = "mean_miou") -> DataFrame:
    """``rank, method, ..`` of the methods that are ok at a budget (the greatest by default); scores descending, null last, then the name."""
    if budget is None:
        top = summary.agg(F.max("budget").alias("budget"))
        rows = summary.join(F.broadcast(top), "budget")  # one row
    else:
        rows = summary.where(F.col("budget") == budget)
    w = Window.orderBy(F.col(score).desc_nulls_last(), "method")
    return rows.where("status = 'ok'").withColumn("rank", F.row_number().over(w))  # one row a method


def best_per_group(rows: DataFrame, group: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark's group limit keeps n a partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def take_top(rows: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    """The n greatest scores, null and NaN left out; a report, so the limit is the feature."""
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.col(score).desc(), tie).limit(n)


def best_flags(means: DataFrame, name: str, higher: tuple[str, ...], lower: tuple[str, ...] = ()) -> DataFrame:
    """``name, metric, value, best``: every metric's best rows flagged, ties all."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(1.0 if m in higher else -1.0).alias("sign")) for m in higher + lower])
    rows = means.select(name, F.inline(each))
    top = F.max(F.col("value") * F.col("sign")).over(Window.partitionBy("metric"))
    return rows.withColumn("best", F.col("value") * F.col("sign") == top).select(name, "metric", "value", "best")


def final_and_best(rows: DataFrame, by: str = "run", order: str = "step", score: str = "miou") -> DataFrame:
    """The last row and the first best row of each run, and the number of rows, in one aggregate."""
    row = F.struct(order, score)
    best = F.struct(F.coalesce(finite(F.col(score)), F.lit(-1.0)).alias("s"), (-F.col(order)).alias("o"))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.max(row).alias("last"), F.max(best).alias("best"))
    return out.select(by, "n_rows", F.col(f"last.{order}").alias("final_step"), F.col(f"last.{score}").alias(f"final_{score}"), (-F.col("best.o")).alias("best_step"), F.col("best.s").alias(f"best_{score}"))


def parameter_grid(spark: SparkSession, lists: dict[str, list]) -> DataFrame:
    """All combinations of the parameters' values, made on the executors from one row."""
    out = spark.range(1).select()
    for name, values in lists.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def ordered_case(text: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str) -> Column:
    """The first rule of which a part occurs in the lower-case text."""
    low = F.lower(text)
    hit = lambda parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
    return F.coalesce(*[F.when(hit(parts), F.lit(label)) for parts, label in rules], F.lit(otherwise))


#: Parts of a lower-case path and the family that they stand for, the first that occurs.
FAMILIES = [
    (("/interactive_runs/",), "interactive-run"), (("/sweeps/",), "sweep"), (("/refinement/",), "refinement"), (("/postprocessing/",), "postprocessing"),
    (("/case_studies/",), "case-study"), (("/training/",), "training"), (("/precomputed/",), "precomputed"), (("/debug/",), "debug"),
]
#: The same for the status of what lies there; all else is main.
STATUSES = [
    (("/uncategorized/",), "uncategorized"), (("/debug/", "_tmp_eval_", "tmp_replay_debug"), "debug"), (("smoke",), "smoke"), (("/training/",), "main"),
    (("/case_studies/", "_quarter_run", "_two_quarters"), "case-study"), (("/sweeps/", "/refinement/"), "archive"),
]


def family(path: Column) -> Column:
    return ordered_case(path, FAMILIES, "uncategorized")


def status(path: Column) -> Column:
    return ordered_case(path, STATUSES, "main")


def family_report(runs: DataFrame) -> DataFrame:
    """``family, n, sample, statuses``: runs by family, the least path, and a histogram of their statuses as text."""
    named = runs.withColumn("family", family(F.col("path"))).withColumn("kind", status(F.col("path")))
    cells = named.groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("sample"))
    hist = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ", ")
    return cells.groupBy("family").agg(F.sum("n").alias("n"), F.min("sample").alias("sample"), hist.alias("statuses"))


def catalog_union(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def without_failed(rows: DataFrame, keys: tuple[str, ...] = ("method", "image")) -> DataFrame:
    """Rows whose (method, image) never failed."""
    failed = rows.where("status <> 'ok'").select(*keys).distinct()
    return rows.join(failed, list(keys), "left_anti")


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """``line_no, line``: the rows as a Markdown table with aligned columns, for reports of few rows."""
    text = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], F.row_number().over(Window.orderBy(*order)).alias("line_no"))
    widths = text.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"w_{c}") for c in columns])
    both = text.join(F.broadcast(widths))  # one row
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.expr(f"rpad(`{c}`, `w_{c}`, ' ')") for c in columns]), F.lit(" |"))
    head = widths.select(F.lit(-1).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.expr(f"rpad('{c}', `w_{c}`, ' ')") for c in columns]), F.lit(" |")).alias("line"))
    rule = widths.select(F.lit(0).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.expr(f"repeat('-', `w_{c}`)") for c in columns]), F.lit(" |")).alias("line"))
    return head.unionByName(rule).unionByName(both.select("line_no", line.alias("line")))


def suggest(spark: SparkSession, space: dict[str, tuple], trials: int, seed: int = 0) -> DataFrame:
    """``trial`` and a value of each parameter, drawn at random but alike on any cluster.

    A parameter is ``(low, high)``, ``(low, high, "log")``, ``(low, high, step)``
    with a whole step, or a list of choices. Low and high are both possible.
    """
    out = spark.range(trials).select(F.col("id").alias("trial"))
    for name, kind in space.items():
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "trial"), F.lit(1 << 52)) / float((1 << 52) - 1)
        if isinstance(kind, list):
            value = F.element_at(F.array(*[F.lit(v) for v in kind]), F.least(F.floor(u * len(kind)), F.lit(len(kind) - 1)).cast("int") + 1)
        elif len(kind) == 2:
            value = kind[0] + u * (kind[1] - kind[0])
        elif kind[2] == "log":
            value = F.exp(F.log(F.lit(float(kind[0]))) + u * (F.log(F.lit(float(kind[1]))) - F.log(F.lit(float(kind[0])))))
        else:
            n = (kind[1] - kind[0]) // kind[2] + 1
            value = (F.lit(kind[0]) + F.least(F.floor(u * n), F.lit(n - 1)) * kind[2]).cast("int")
        out = out.withColumn(name, value)
    return out


def best_trials(trials: DataFrame, by: str = "method", score: str = "score") -> DataFrame:
    """The best trial of each method, the first on a tie; null and NaN don't count."""
    return best_per_group(trials.where(F.col(score).isNotNull() & ~F.isnan(score)), by, [F.col(score).desc(), F.col("trial")])
