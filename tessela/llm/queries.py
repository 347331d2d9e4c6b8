"""Queries of the training-data problems (p2, p3, p7, p8, p9) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm import leakage, percentiles, reading, tokens, topn
from tessela.llm.names import case_groups, method_name
from tessela.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_n(table(spark, d, "step_metrics"), case_groups(table(spark, d, "sweep_cases")), 5)
    return best.select("method", "label", "metric_id")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "step_metrics"), case_groups(table(spark, d, "sweep_cases")), 5)


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """The methods that ``method_stats`` lists."""
    return table(spark, d, "method_stats").select(method_name(F.col("method")).alias("method")).where("method <> ''").distinct()


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.step_sketch(table(spark, d, "step_metrics"), case_groups(table(spark, d, "sweep_cases")))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each listed method, one row each: of every day, and of the days' sketches added together.

    Values are shares, rounded to nine digits so that other engines give the same.
    ``span`` is ``day`` or ``all``; a listed method without values has only its row of ``all``, with nulls.
    """
    daily = _daily(spark, d)
    of_day = percentiles.percentiles(daily, ["method", "day"]).withColumn("span", F.lit("day"))
    of_all = percentiles.percentiles(percentiles.merge(daily, ["method"]), ["method"])
    wanted = _listed(spark, d).select("method", F.explode(F.array(F.lit("miou"), F.lit("coverage"))).alias("metric"))
    of_all = wanted.join(of_all, ["method", "metric"], "left").na.fill(0, ["n_values"]).select("*", F.lit(None).cast("date").alias("day"), F.lit("all").alias("span"))
    both = of_day.join(_listed(spark, d), "method").unionByName(of_all)
    each = F.array(*[F.struct(F.lit(q).alias("quantile"), F.round(F.col(percentiles.column(q)), 9).alias("value")) for q in percentiles.QUANTILES])
    return both.select("method", "span", "day", "metric", "n_values", F.inline(each))


def p3_methods(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each listed method over all days, side by side."""
    whole = percentiles.percentiles(percentiles.merge(_daily(spark, d), ["method"]), ["method"])
    named = [F.round(F.col(percentiles.column(q)), 9).alias(percentiles.column(q)) for q in percentiles.QUANTILES]
    return whole.join(_listed(spark, d), "method").select("method", "metric", "n_values", *named)


def p3_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The daily sketches themselves, as they would be stored and added together."""
    return _daily(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each token occurs in the corpus."""
    return tokens.token_counts(tokens.encode(table(spark, d, "documents")))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again, by hash; its SQL is the hash of the text itself."""
    again = tokens.decode(tokens.encode(table(spark, d, "documents")))
    return again.select("doc_id", F.md5("text").alias("md5"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "graded_texts")).select("doc_id", "grade_level").distinct()


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words of English prose at each level."""
    rows = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "graded_texts"))
    return rows.groupBy("grade_level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_words").cast("bigint")).alias("n_words"))


QUERIES = {
    f.__name__: f for f in (p2_found, p2_top, p3_percentiles, p3_methods, p3_sketches, p7_ids, p7_counts, p7_decoded, p8_found, p9_found, p9_profile)
}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NAME = (
    "CASE regexp_replace(lower(method), '^" + _SPACE + "|" + _SPACE + "$', '', 'g') WHEN 'fwb' THEN 'felzenszwalb' WHEN 'ws' THEN 'watershed' "
    "ELSE regexp_replace(lower(method), '^" + _SPACE + "|" + _SPACE + "$', '', 'g') END"
)
_CASES = f"""named AS (SELECT case_id, {_NAME} AS method, label, created_at FROM sweep_cases WHERE case_id IS NOT NULL),
cases AS (SELECT case_id, method, label FROM named
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC NULLS LAST, method DESC NULLS LAST, label DESC NULLS LAST) = 1)"""
_TOP = f"""WITH {_CASES},
steps AS (SELECT DISTINCT metric_id, case_id, step, CASE WHEN NOT isnan(coverage) THEN coverage END AS coverage, miou
  FROM step_metrics WHERE miou IS NOT NULL AND NOT isnan(miou)),
ranked AS (SELECT method, label, metric_id, miou, coverage, step, CAST(row_number() OVER (PARTITION BY method, label
  ORDER BY miou DESC, coverage DESC NULLS LAST, step ASC NULLS LAST, metric_id ASC NULLS LAST) AS INTEGER) AS rank FROM steps JOIN cases USING (case_id))"""
_G = (1 + percentiles.ERROR) / (1 - percentiles.ERROR)
_BUCKET = f"CASE WHEN v < 1e-300 THEN 0 ELSE CAST(ceil(ln(v) / {math.log(_G)!r}) AS INTEGER) + {1 << 20} END"
_SKETCH = f"""WITH {_CASES},
once AS (SELECT metric_id, any_value(case_id) AS case_id, any_value(CAST(logged_at AS DATE)) AS day, any_value(miou) AS miou, any_value(coverage) AS coverage
  FROM step_metrics GROUP BY metric_id),
vals AS (SELECT method, day, 'miou' AS metric, miou AS v FROM once JOIN cases USING (case_id)
  UNION ALL SELECT method, day, 'coverage', coverage FROM once JOIN cases USING (case_id)),
sketch AS (SELECT method, day, metric, {_BUCKET} AS bucket, count(*) AS n FROM vals WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL),
listed AS (SELECT DISTINCT {_NAME} AS method FROM method_stats WHERE method IS NOT NULL AND {_NAME} <> '')"""
_VALUE = f"round(CASE WHEN bucket = 0 THEN 0.0 ELSE pow({_G!r}, bucket - {1 << 20}) * {2 / (_G + 1)!r} END, 9)"
_QUANTILES = ", ".join(f"(CAST({q!r} AS DOUBLE))" for q in percentiles.QUANTILES)
ORACLE = {
    "p2_found": _TOP + " SELECT method, label, metric_id FROM ranked WHERE rank <= 5",
    "p2_top": _TOP + " SELECT method, label, metric_id, rank, miou, coverage, step FROM ranked WHERE rank <= 5",
    "p3_percentiles": _SKETCH
    + f""",
spans AS (SELECT method, 'day' AS span, day, metric, bucket, n FROM sketch UNION ALL SELECT method, 'all', NULL, metric, bucket, sum(n) FROM sketch GROUP BY method, metric, bucket),
runs AS (SELECT *, sum(n) OVER (PARTITION BY method, span, day, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY method, span, day, metric) AS total FROM spans),
q(quantile) AS (VALUES {_QUANTILES}),
found AS (SELECT method, span, day, metric, CAST(total AS BIGINT) AS n_values, quantile, min(bucket) AS bucket FROM runs, q WHERE upto >= greatest(1, ceil(quantile * total)) GROUP BY ALL)
SELECT method, span, day, metric, n_values, quantile, {_VALUE} AS value FROM found JOIN listed USING (method)
UNION ALL SELECT method, 'all', NULL, metric, 0, quantile, NULL FROM listed, (VALUES ('miou'), ('coverage')) m(metric), q
  WHERE NOT EXISTS (SELECT 1 FROM sketch s WHERE s.method = listed.method AND s.metric = m.metric)""",
    "p3_methods": _SKETCH
    + f""",
whole AS (SELECT method, metric, bucket, sum(n) AS n FROM sketch JOIN listed USING (method) GROUP BY ALL),
runs AS (SELECT *, sum(n) OVER (PARTITION BY method, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY method, metric) AS total FROM whole)
SELECT method, metric, CAST(max(total) AS BIGINT) AS n_values, """
    + ", ".join(f"min({_VALUE}) FILTER (upto >= greatest(1, ceil({q!r} * total))) AS {percentiles.column(q)}" for q in percentiles.QUANTILES)
    + " FROM runs GROUP BY method, metric",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    "p3_sketches": _SKETCH + " SELECT method, day, metric, bucket, n FROM sketch",
}
