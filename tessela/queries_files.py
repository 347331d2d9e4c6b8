"""Queries of states, listings, rasters and proposals, with SQL where DuckDB can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.operators import raster
from tessela.plans import adapters
from tessela.plans import relations as rel
from tessela.queries_data import _OPEN, points_sql
from tessela.queries_regions import GRID
from tessela.sinks import before_after, study_summary
from tessela.sources import images, logs, states
from tessela.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(df, *cols, to=6):
    return df.withColumns({c: F.round(c, to) for c in cols})


@query("""WITH s AS (SELECT DISTINCT spanno_path AS p FROM sweep_cases WHERE spanno_path IS NOT NULL), r AS (SELECT DISTINCT run_dir AS p FROM sweep_cases WHERE run_dir IS NOT NULL),
a AS (SELECT p, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.spanno\\.json\\.gz$', '') AS stem FROM s), b AS (SELECT p, regexp_extract(p, '([^/]*)$', 1) AS stem FROM r) SELECT a.p AS state, b.p AS run_dir FROM a JOIN b USING (stem)""")
def state_run_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "sweep_cases")
    a = c.select(F.col("spanno_path").alias("state")).dropna().distinct().withColumn("stem", F.regexp_replace(images.file_name(F.col("state")), r"\.spanno\.json\.gz$", ""))
    b = c.select("run_dir").dropna().distinct().withColumn("stem", images.file_name(F.col("run_dir")))
    return a.join(b, "stem").select("state", "run_dir")


@query("""WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS run_dir, path, regexp_extract(path, '([^/]*)$', 1) AS n FROM state_files WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^state_.*\\.json(\\.gz)?$')),
i AS (SELECT run_dir, path, coalesce(TRY_CAST(regexp_extract(n, '([0-9]+)\\.json(\\.gz)?$', 1) AS INTEGER), -1) AS k FROM f) SELECT run_dir, max({'k': k, 'p': path}).p AS path, max(k) AS state_index FROM i GROUP BY run_dir""")
def latest_state_files(spark, d):
    return images.latest_states(table(spark, d, "state_files"))


@query("SELECT string_split(regexp_replace(path, '^.*?/(data|mnt)/', '', ''), '/')[1] AS child, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM state_files GROUP BY 1")
def storage_inventory(spark, d):
    rest = F.regexp_replace("path", "^.*?/(data|mnt)/", "")
    return images.inventory(table(spark, d, "state_files").withColumn("path", F.concat(F.lit("/r/"), rest)), "/r")


@query("WITH v AS (SELECT l_linenumber AS image, count(DISTINCT l_suppkey) AS n_codes FROM lineitem WHERE l_suppkey NOT IN (1, 2) GROUP BY 1) SELECT image, n_codes FROM v ORDER BY n_codes DESC, image LIMIT 1")
def richest_image(spark, d):
    return images.richest_image(rel.pixels(spark, d).select("image", F.col("sp").alias("gt")), [1, 2])


@query(f"""WITH {_OPEN}, sp AS (SELECT record_id, k, e, json_extract(e, '$.border') AS b, CASE WHEN json_type(json_extract(e, '$.holes')) = 'ARRAY' THEN json_extract(e, '$.holes[*]') ELSE [] END AS h FROM items WHERE t = 'sp' AND json_type(e) = 'OBJECT')
SELECT DISTINCT record_id, k AS method, TRY_CAST(json_extract_string(e, '$.id') AS INTEGER) AS id, CAST(coalesce({points_sql('b')}, 0) AS INTEGER) AS n_border, CAST(len(list_filter(h, lambda r: coalesce({points_sql('r')}, 0) >= 3)) AS INTEGER) AS n_holes,
 TRY_CAST(json_extract_string(e, '$.parents[#-1]') AS INTEGER) AS direct_parent FROM sp""")
def state_superpixels(spark, d):
    return states.superpixels(states.states(table(spark, d, "state_docs"))).distinct()


@query(f"""WITH newest AS (SELECT record_id, max({{'t': received_at, 'd': doc_json}}).d AS doc_json FROM state_docs GROUP BY record_id), {_OPEN.replace('FROM state_docs', 'FROM newest')},
sp AS (SELECT record_id, k, TRY_CAST(json_extract_string(e, '$.id') AS INTEGER) AS id, coalesce({points_sql("json_extract(e, '$.border')")}, 0) AS n FROM items WHERE t = 'sp' AND json_type(e) = 'OBJECT'),
an AS (SELECT record_id, k, TRY_CAST(json_extract_string(e, '$.id') AS INTEGER) AS id, coalesce(TRY_CAST(json_extract_string(e, '$.parent_superpixel') AS INTEGER), -1) AS p FROM items WHERE t = 'an' AND json_type(e) = 'OBJECT')
SELECT record_id, 'header' AS rule, NULL AS method, NULL AS id FROM states WHERE coalesce(json_extract_string(s, '$._meta.magic'), 'spanno') <> 'spanno' OR coalesce(TRY_CAST(json_extract_string(s, '$._meta.version') AS INTEGER), 1) > 3
UNION ALL SELECT record_id, 'repeated superpixel', k, id FROM sp GROUP BY record_id, k, id HAVING count(*) > 1 UNION ALL SELECT record_id, 'short border', k, id FROM sp WHERE n < 3
UNION ALL SELECT record_id, 'no superpixel', k, id FROM an WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.record_id = an.record_id AND sp.k = an.k AND sp.id = an.p)
UNION ALL SELECT record_id, 'several annotations', k, p FROM an GROUP BY record_id, k, p HAVING count(*) > 1""")
def state_violations(spark, d):
    return states.violations(states.states(states.latest(table(spark, d, "state_docs"))))


@query("SELECT DISTINCT metric_id, CASE WHEN isnan(miou) THEN NULL ELSE miou END AS miou FROM step_metrics")
def coerced_cells(spark, d):
    return table(spark, d, "step_metrics").select("metric_id", logs.coerce(F.col("miou").cast("string")).alias("miou")).distinct()


@query("""SELECT o_orderpriority AS run, count(*) AS n_lines, count(*) FILTER (o_orderstatus = 'P') AS n_errors, arg_min(o_orderdate, o_orderkey) AS started, arg_max(o_orderdate, o_orderkey) AS ended,
 CAST(epoch(arg_max(o_orderdate, o_orderkey)) - epoch(arg_min(o_orderdate, o_orderkey)) AS BIGINT) AS duration_s FROM orders GROUP BY 1""")
def run_log_summary(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("o_orderstatus") == "P", F.lit(" ERROR x")).otherwise(F.lit(" ok")))
    return logs.run_log(o.select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("line_no"), text.alias("line"))).drop("image")


@query("""WITH s AS (SELECT event_type AS stage, count(*) AS n, sum(value) AS total_ms, avg(value) AS mean_ms FROM events GROUP BY 1)
SELECT stage, n, round(total_ms, 3) AS total_ms, round(mean_ms, 5) AS mean_ms, round(total_ms / (SELECT sum(total_ms) FROM s), 6) AS share FROM s""")
def stage_times(spark, d):
    out = logs.stage_report(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))
    return _r(_r(_r(out, "total_ms", to=3), "mean_ms", to=5), "share")


@query("""WITH t AS (SELECT user_id AS study, event_id AS trial, value AS score FROM events) SELECT study, count(*) AS n_trials, arg_max(trial, {'s': score, 't': -trial}) AS best_trial, max(score) AS best_score FROM t GROUP BY study""")
def study_report(spark, d):
    e = table(spark, d, "events")
    return study_summary(e.select(F.col("user_id").alias("study"), F.col("event_id").alias("trial"), F.col("value").alias("score")))


@query("""WITH b AS (SELECT event_type AS k, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type AS k, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT k AS method, 'score' AS metric, round(b.v, 5) AS before, round(a.v, 5) AS after, round(a.v - b.v, 5) AS delta FROM b FULL JOIN a USING (k)""")
def before_after_report(spark, d):
    e = table(spark, d, "events")
    mean = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("score"))
    return _r(before_after(mean(0), mean(1), "method", ("score",)), "before", "after", "delta", to=5)


@query("WITH " + GRID + """, c AS (SELECT image, gt, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM grid GROUP BY ALL)
SELECT image, gt, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 4) AS major, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 4) AS minor FROM c""")
def principal_axes(spark, d):
    return _r(_r(raster.principal_axes(rel.grid(spark, d), ("image", "gt")).drop("angle"), "cx", "cy", to=5), "major", "minor", to=4)


@query("WITH " + GRID + """, k AS (SELECT image, x, y, CASE WHEN y > 4 AND y <= 20 AND x >= 8 AND x < 24 THEN 2 WHEN y > 2 AND y <= 12 AND x >= 4 AND x < 16 THEN 1 ELSE -1 END AS code FROM grid) SELECT image, code, count(*) AS n FROM k GROUP BY ALL""")
def painted_shapes(spark, d):
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    box = lambda a, b, e, f: F.array(pt(a, b), pt(e, b), pt(e, f), pt(a, f))
    g = rel.grid(spark, d)
    shapes = g.select("image").distinct().select("image", F.inline(F.array(
        F.struct(F.lit(1).alias("seq"), F.lit(1).alias("code"), box(4, 2.5, 16, 12.5).alias("ring")), F.struct(F.lit(2).alias("seq"), F.lit(2).alias("code"), box(8, 4.5, 24, 20.5).alias("ring")),
    )))
    return raster.paint(g, shapes).groupBy("image", "code").agg(F.count(F.lit(1)).alias("n"))


@query()
def grid_segmentation(spark, d):
    t = rel.grid(spark, d).select("image", "x", "y", F.col("sp").cast("double").alias("value"))
    out = raster.per_image(t, raster.grid_segments, "value", "segment", "long", count=64)
    return out.groupBy("image", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s AS image, CAST(event_id AS INTEGER) AS interaction_id, kind, round(size, 6) AS size, round(1 / (1 + size), 6) AS score FROM (SELECT 'u' || user_id AS s, event_id, 'circle' AS kind, 2.0 * (value / 100) AS size FROM events WHERE event_type IN ('click', 'view'))")
def method_proposals(spark, d):
    e = table(spark, d, "events")
    kinds = F.when(F.col("event_type") == "click", "point").when(F.col("event_type") == "view", "scribble").otherwise("box")
    prompts = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("image"), F.col("event_id").cast("int").alias("interaction_id"), F.lit(1).alias("class_id"), kinds.alias("prompt_type"),
                       F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), (F.col("value") / 100).alias("radius"))
    return _r(adapters.predict(prompts, "mock_circle").select("image", "interaction_id", "kind", "size", "score"), "size", "score")


@query("""WITH p AS (SELECT l_orderkey AS image, CAST(l_partkey % 4 AS INTEGER) AS interaction_id, l_suppkey AS candidate_id, round(l_discount, 2) AS iou, CASE WHEN l_tax > 0.02 THEN l_tax END AS score FROM lineitem)
SELECT DISTINCT image, interaction_id, candidate_id, iou, score FROM p QUALIFY rank() OVER (PARTITION BY image, interaction_id ORDER BY iou DESC, coalesce(score, -1) DESC, candidate_id) = 1""")
def best_proposal(spark, d):
    c = F.col
    p = table(spark, d, "lineitem").select(c("l_orderkey").alias("image"), (c("l_partkey") % 4).cast("int").alias("interaction_id"), c("l_suppkey").alias("candidate_id"), F.round("l_discount", 2).alias("iou"), F.when(c("l_tax") > 0.02, c("l_tax")).alias("score"))
    return adapters.best_proposals(p)


@query("""SELECT * FROM (VALUES ('mock_circle', true, '', ['point', 'scribble']), ('mock_line', true, '', ['line', 'scribble']), ('mock_box', true, '', ['box', 'point']), ('absent', false, 'unknown', [])) v(method_id, available, reason, prompt_types)""")
def method_availability(spark, d):
    return adapters.availability(spark, ["mock_circle", "MOCK_LINE", "mock_box", "absent"])
