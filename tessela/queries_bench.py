"""Queries of benchmarks, sweeps, catalogs, names and event logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessela.functions import geometry, text
from tessela.operators import bench, events, spatial
from tessela.operators.raster import region_priority
from tessela.operators.hierarchy import build_hierarchy, descendants
from tessela.plans import relations as rel
from tessela.sources.tables import table
from tessela.streaming.replay import state_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BENCH = """b AS (SELECT event_id, event_type AS method, CAST(user_id % 5 AS INTEGER) AS budget, user_id AS image, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status,
 value / 500 AS miou, event_id % 100 / 100 AS coverage FROM events)"""
STEPS = "st AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS ink, event_type AS cls, value / 500 AS miou FROM events)"
RUNS = """rn AS (SELECT o_orderkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN '/repo/artifacts/sweeps/' WHEN '2-HIGH' THEN '/repo/artifacts/interactive_runs/' WHEN '3-MEDIUM' THEN '/repo/artifacts/case_studies/'
 WHEN '5-LOW' THEN '/repo/artifacts/debug/smoke_' ELSE '/repo/Other/Smoke_' END || 'run_' || o_orderkey AS path, o_orderstatus AS status, o_totalprice AS metric FROM orders)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(df, *cols, to=6):
    return df.withColumns({c: F.round(c, to) for c in cols})


@query(f"""WITH {STEPS}, bu(budget) AS (VALUES {', '.join(f'({b})' for b in rel.BUDGETS)}),
p AS (SELECT run, CAST(budget AS INTEGER) AS budget, max(step) FILTER (step <= budget) AS s, min(step) AS f FROM st, bu GROUP BY ALL)
SELECT p.run, budget, CAST(st.step AS INTEGER) AS step, miou FROM p JOIN st ON st.run = p.run AND st.step = coalesce(p.s, p.f)""")
def asof_budget(spark, d):
    return spatial.asof_budgets(rel.steps(spark, d), list(rel.BUDGETS))


@query(f"WITH {STEPS} SELECT run, CAST(step AS INTEGER) AS step, count(*) OVER w AS n_scribbles, round(sum(ink) OVER w, 4) AS total_ink FROM st WINDOW w AS (PARTITION BY run ORDER BY step)")
def running_cost(spark, d):
    return _r(events.running_cost(rel.steps(spark, d)).select("run", "step", "n_scribbles", "total_ink"), "total_ink", to=4)


@query(f"WITH {STEPS} SELECT run, CAST(step AS INTEGER) AS step, coalesce(miou > lag(miou) OVER (PARTITION BY run ORDER BY step), true) AS progress FROM st")
def progress_flag(spark, d):
    return events.progress(rel.steps(spark, d)).select("run", "step", "progress")


@query(f"""WITH {STEPS}, p AS (SELECT *, coalesce(miou > lag(miou) OVER (PARTITION BY run ORDER BY step), true) AS ok FROM st),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY run ORDER BY step) AS g FROM p) SELECT run, CAST(step AS INTEGER) AS step, CAST(row_number() OVER (PARTITION BY run, g ORDER BY step) - 1 AS INTEGER) AS stall FROM i""")
def stall_streak(spark, d):
    return events.stalls(rel.steps(spark, d)).select("run", "step", "stall")


@query(f"WITH {STEPS}, l AS (SELECT run, list(miou ORDER BY step) AS v FROM st GROUP BY run) SELECT run, round(list_reduce(v, lambda a, x: 0.9 * a + 0.1 * x), 8) AS ema FROM l")
def ema_series(spark, d):
    return _r(events.ema(rel.steps(spark, d)), "ema", to=8)


@query(f"WITH {STEPS}, g AS (SELECT *, ink - lag(ink) OVER (PARTITION BY run ORDER BY step) AS dx FROM st) SELECT run, round(coalesce(sum(sqrt(dx * dx + 1)), 0), 4) AS length FROM g GROUP BY run")
def polyline_length(spark, d):
    w = Window.partitionBy("run").orderBy("step")
    legs = rel.steps(spark, d).withColumn("dx", F.col("ink") - F.lag("ink").over(w))
    return _r(legs.groupBy("run").agg(F.coalesce(F.sum(F.sqrt(F.col("dx") ** 2 + 1)), F.lit(0.0)).alias("length")), "length", to=4)


_SUM = f"""WITH {BENCH}, su AS (SELECT method, budget, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_failed, avg(miou) FILTER (status = 'ok') AS mean_miou,
 avg(coverage) FILTER (status = 'ok') AS mean_coverage FROM b GROUP BY ALL)"""


@query(_SUM + " SELECT method, budget, n_ok, n_failed, round(mean_miou, 6) AS mean_miou, round(mean_coverage, 6) AS mean_coverage, CASE WHEN n_ok > 0 THEN 'ok' ELSE 'failed' END AS status FROM su")
def bench_summary(spark, d):
    return _r(bench.summarise(rel.bench_rows(spark, d)), "mean_miou", "mean_coverage")


@query("SELECT event_type AS method, user_id % 3 AS device, round(avg(value), 5) AS mean_wall, max(value) AS max_wall, count(*) FILTER (value > 100) AS limit_hits FROM events GROUP BY ALL")
def resource_summary(spark, d):
    out = table(spark, d, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 3).alias("device"))
    return _r(out.agg(F.avg("value").alias("mean_wall"), F.max("value").alias("max_wall"), F.count_if(F.col("value") > 100).alias("limit_hits")), "mean_wall", to=5)


@query(_SUM + " SELECT CAST(row_number() OVER (ORDER BY mean_miou DESC NULLS LAST, method) AS INTEGER) AS rank, method, round(mean_miou, 6) AS mean_miou FROM su WHERE budget = (SELECT max(budget) FROM su) AND n_ok > 0")
def leaderboard(spark, d):
    return _r(bench.leaderboard(bench.summarise(rel.bench_rows(spark, d))).select("rank", "method", "mean_miou"), "mean_miou")


@query(_SUM + ", m AS (SELECT method, avg(mean_miou) AS mean_miou, avg(mean_coverage) AS mean_coverage FROM su GROUP BY method) SELECT method, round(mean_miou, 6) AS mean_miou, round(mean_coverage, 6) AS mean_coverage FROM m UNION ALL SELECT 'MEAN', round(avg(mean_miou), 6), round(avg(mean_coverage), 6) FROM m")
def batch_summary_with_mean(spark, d):
    per = bench.summarise(rel.bench_rows(spark, d)).groupBy("method").agg(F.avg("mean_miou").alias("mean_miou"), F.avg("mean_coverage").alias("mean_coverage"))
    return _r(bench.with_mean_row(per, "method", ("mean_miou", "mean_coverage")), "mean_miou", "mean_coverage")


@query(f"WITH {BENCH} SELECT method, event_id, miou FROM b WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY method ORDER BY miou DESC NULLS LAST, coverage DESC, event_id) = 1")
def best_per_group(spark, d):
    ok = rel.bench_rows(spark, d).where("status = 'ok'")
    return bench.best_per_group(ok, "method", [F.col("miou").desc_nulls_last(), F.col("coverage").desc(), F.col("event_id")]).select("method", "event_id", "miou")


@query(f"WITH {BENCH} SELECT event_id, miou FROM b WHERE miou IS NOT NULL ORDER BY miou DESC, event_id LIMIT 10")
def topk_drop_null(spark, d):
    return bench.take_top(rel.bench_rows(spark, d).select("event_id", "miou"), "miou", 10, "event_id")


@query(f"""WITH {STEPS} SELECT run, count(*) AS n_rows, CAST(max(step) AS INTEGER) AS final_step, arg_max(miou, step) AS final_miou,
 CAST(-max({{'s': coalesce(miou, -1), 'o': -step}}).o AS INTEGER) AS best_step, max(coalesce(miou, -1)) AS best_miou FROM st GROUP BY run""")
def final_and_best_row(spark, d):
    return bench.final_and_best(rel.steps(spark, d))


@query("WITH c AS (SELECT l_linenumber AS class, l_suppkey AS comp, count(*) AS area FROM lineitem GROUP BY ALL) SELECT class, comp, area FROM c QUALIFY row_number() OVER (PARTITION BY class ORDER BY area DESC, comp DESC) <= 3")
def topk_components_per_class(spark, d):
    areas = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("class"), F.col("l_suppkey").alias("comp")).agg(F.count(F.lit(1)).alias("area"))
    return bench.best_per_group(areas, "class", [F.col("area").desc(), F.col("comp").desc()], 3).select("class", "comp", "area")


@query(f"""WITH {BENCH}, m AS (SELECT method, round(avg(miou), 6) AS miou, round(avg(coverage), 6) AS coverage, CAST(count(*) AS DOUBLE) AS cost FROM b GROUP BY method),
u AS (SELECT method, 'miou' AS metric, miou AS value, 1 AS s FROM m UNION ALL SELECT method, 'coverage', coverage, 1 FROM m UNION ALL SELECT method, 'cost', cost, -1 FROM m)
SELECT method, metric, value, value * s = max(value * s) OVER (PARTITION BY metric) AS best FROM u""")
def best_flag_per_metric(spark, d):
    means = rel.bench_rows(spark, d).groupBy("method").agg(F.round(F.avg("miou"), 6).alias("miou"), F.round(F.avg("coverage"), 6).alias("coverage"), F.count(F.lit(1)).alias("cost"))
    return bench.best_flags(means, "method", ("miou", "coverage"), ("cost",))


@query("SELECT r_name AS method, n_nationkey AS n_segments, c.compactness FROM region, nation, (SELECT unnest([5, 10, 20]) AS compactness) c")
def param_grid(spark, d):
    dims = table(spark, d, "region").select(F.col("r_name").alias("method"))
    grid = bench.parameter_grid(spark, {"compactness": [5, 10, 20]})
    return dims.crossJoin(grid).crossJoin(table(spark, d, "nation").select(F.col("n_nationkey").alias("n_segments")))  # all combinations are the result


def _rules(rules, otherwise):
    """Rules of parts of a path as SQL."""
    cases = " ".join(f"WHEN {' OR '.join(f"contains(lower(path), '{p}')" for p in parts)} THEN '{label}'" for parts, label in rules)
    return f"CASE {cases} ELSE '{otherwise}' END"


_FAM, _STA = _rules(bench.FAMILIES, "uncategorized"), _rules(bench.STATUSES, "main")


@query(f"WITH {RUNS} SELECT run_id, {_FAM} AS family FROM rn")
def classify_family(spark, d):
    return rel.runs(spark, d).select("run_id", bench.family(F.col("path")).alias("family"))


@query(f"WITH {RUNS} SELECT run_id, {_STA} AS kind FROM rn")
def classify_status(spark, d):
    return rel.runs(spark, d).select("run_id", bench.status(F.col("path")).alias("kind"))


@query(f"""WITH {RUNS}, k AS (SELECT {_FAM} AS family, {_STA} AS kind, path FROM rn), c AS (SELECT family, kind, count(*) AS n, min(path) AS sample FROM k GROUP BY ALL)
SELECT family, CAST(sum(n) AS BIGINT) AS n, min(sample) AS sample, string_agg(kind || '=' || n, ', ' ORDER BY kind) AS statuses FROM c GROUP BY family""")
def family_histogram(spark, d):
    return bench.family_report(rel.runs(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 250000) AS large, count(DISTINCT o_custkey) AS owners FROM orders")
def catalog_counters(spark, d):
    return table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 250000).alias("large"), F.count_distinct("o_custkey").alias("owners")
    )


@query(f"""WITH {RUNS} SELECT 'run' AS kind, CAST(run_id AS VARCHAR) AS name, metric, NULL AS n FROM rn UNION ALL SELECT 'summary', status, NULL, count(*) FROM rn GROUP BY status""")
def run_catalog_union(spark, d):
    r = rel.runs(spark, d)
    top = r.select(F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("name"), "metric")
    return bench.catalog_union(top, r.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("summary")))


@query(f"""WITH {BENCH}, ok AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b f WHERE f.method = b.method AND f.image = b.image AND f.status <> 'ok'))
SELECT method, count(*) AS n, round(avg(miou), 6) AS mean, round(var_pop(miou), 8) AS variance FROM ok GROUP BY method""")
def failed_anti_stats(spark, d):
    ok = bench.without_failed(rel.bench_rows(spark, d)).groupBy("method")
    return _r(_r(ok.agg(F.count(F.lit(1)).alias("n"), F.avg("miou").alias("mean"), F.var_pop("miou").alias("variance")), "mean"), "variance", to=8)


@query("SELECT p_brand AS method FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 45")
def method_overlap(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size < 10").select(F.col("p_brand").alias("method")).intersect(p.where("p_size > 45").select("p_brand"))


@query("SELECT p_brand AS method FROM part WHERE p_size < 3 UNION SELECT p_type FROM part")
def method_union_distinct(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size < 3").select(F.col("p_brand").alias("method")).union(p.select("p_type")).distinct()


_TOKEN = "coalesce(nullif(regexp_replace(regexp_replace(replace(%s, '.', 'p'), '[^\\p{L}\\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x')"


@query(f"SELECT p_partkey, {_TOKEN % "'. ' || p_name || '-' || CAST(p_retailprice AS VARCHAR)"} AS token FROM part")
def token_sanitize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sanitize_token(F.concat(F.lit(". "), "p_name", F.lit("-"), F.col("p_retailprice").cast("string"))).alias("token"))


@query("""WITH h AS (SELECT p_partkey, printf('#%06X', (p_partkey * 7919) % 16777216) AS hex FROM part)
SELECT p_partkey, hex, list_transform([2, 4, 6], lambda i: round(CAST(('0x' || substr(hex, i, 2)) AS INTEGER) / 255.0, 6)) AS rgb FROM h""")
def hex_to_rgb(spark, d):
    h = table(spark, d, "part").select("p_partkey", F.format_string("#%06X", (F.col("p_partkey") * 7919) % 16777216).alias("hex"))
    return h.withColumn("rgb", F.transform(text.hex_to_rgb(F.col("hex")), lambda x: F.round(x, 6)))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ' || p_type || ',, ' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM part")
def csv_list_parse(spark, d):
    return table(spark, d, "part").select("p_partkey", text.csv_list(F.concat("p_name", F.lit(", "), "p_type", F.lit(",, "), "p_brand")).alias("items"))


@query("""SELECT DISTINCT method, lower(string_split(string_split(method, '|')[1], '_')[1]) AS family, len(string_split(string_split(method, '|')[1], '_')) - 1 AS n_args,
 CASE WHEN contains(method, '|') THEN regexp_extract(method, '([^/|]*)$', 1) END AS weights FROM superpixels""")
def method_key_parse(spark, d):
    k = table(spark, d, "superpixels").select("method").distinct().withColumn("k", text.method_key(F.col("method")))
    return k.select("method", "k.family", F.size("k.args").cast("bigint").alias("n_args"), "k.weights")


@query("""WITH b AS (SELECT o_orderkey, CAST(o_totalprice * o_orderkey AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.1f B', n / 1.0) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0)
 WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM b""")
def human_size(spark, d):
    n = F.expr("cast(round(o_totalprice * o_orderkey) as bigint)")
    return table(spark, d, "orders").select("o_orderkey", text.human_size(n).alias("size"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT p_partkey, CASE WHEN p_size <= 32 THEN [0] WHEN p_size <= 48 THEN list_sort(list_distinct([0, p_size - 32])) ELSE list_sort(list_distinct([0, 16, p_size - 32])) END AS tiles FROM part")
def tile_starts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_sort(text.tile_starts(F.col("p_size"), 32, 16)).alias("tiles"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN greatest(2, (p_size * 40) * (p_size * 30) // 3920) ELSE 0 END AS n_segments FROM part")
def segment_hint(spark, d):
    p = F.col("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", text.segment_hint(p * 40, p * 30).cast("int").alias("n_segments"))


@query(f"""WITH {STEPS}, e AS (SELECT run, step // 10 AS snap, cls AS item, max(step) % 7 AS code FROM st GROUP BY ALL), m AS (SELECT *, lag(code) OVER w AS before, row_number() OVER w = 1 AS first FROM e WINDOW w AS (PARTITION BY run, item ORDER BY snap))
SELECT run, snap AS step, count(*) FILTER (first) AS added, count(*) FILTER (NOT first AND before <> code) AS changed FROM m GROUP BY ALL""")
def snapshot_diff_events(spark, d):
    snaps = rel.steps(spark, d).groupBy("run", F.floor(F.col("step") / 10).alias("step"), F.col("cls").alias("item")).agg((F.max(F.col("step")) % 7).alias("code"))
    return events.snapshot_changes(snaps)


@query(f"WITH {STEPS} SELECT run, cls, arg_max(ink, step) AS ink FROM st GROUP BY ALL")
def last_update_wins(spark, d):
    return events.last_update(rel.steps(spark, d), ["run", "cls"], [F.col("step")], "ink")


@query(f"WITH {STEPS} SELECT run, cls, count(*) AS n, arg_max(ink, step) AS last_ink, CAST(max(step) AS INTEGER) AS last_step FROM st GROUP BY ALL")
def event_upsert_state(spark, d):
    return state_of(rel.steps(spark, d))


@query(f"WITH {STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS back FROM st) SELECT run, count(*) AS n, round(sum(ink), 4) AS ink FROM k WHERE back > 2 GROUP BY run")
def undo_last(spark, d):
    return _r(events.undo_last(rel.steps(spark, d), 2).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("ink").alias("ink")), "ink", to=4)


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS p FROM customer),
w AS (SELECT p AS ancestor_id, id AS descendant_id, 1 AS distance FROM l WHERE p IS NOT NULL UNION ALL SELECT l.p, w.descendant_id, w.distance + 1 FROM w JOIN l ON l.id = w.ancestor_id WHERE l.p IS NOT NULL)
SELECT ancestor_id, descendant_id, distance FROM w""")
def descendants_closure(spark, d):
    c = table(spark, d, "customer").select(F.lit(0).alias("g"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 0, F.array(F.floor(F.col("c_custkey") / 3))).alias("parents"), F.lit(0).alias("o"))
    return descendants(build_hierarchy(c, ("g",), order_col="o"), ("g",)).drop("g")


@query(_SUM + """, m AS (SELECT method, round(avg(mean_miou), 4) AS v FROM su GROUP BY method), t AS (SELECT method, CAST(v AS VARCHAR) AS v, row_number() OVER (ORDER BY v DESC, method) AS no FROM m),
w AS (SELECT greatest(max(length(method)), 6) AS a, greatest(max(length(v)), 1) AS b FROM t)
SELECT CAST(no AS INTEGER) AS line_no, '| ' || rpad(method, CAST(a AS INTEGER), ' ') || ' | ' || rpad(v, CAST(b AS INTEGER), ' ') || ' |' AS line FROM t, w
UNION ALL SELECT -1, '| ' || rpad('method', CAST(a AS INTEGER), ' ') || ' | ' || rpad('v', CAST(b AS INTEGER), ' ') || ' |' FROM w UNION ALL SELECT 0, '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |' FROM w""")
def markdown_report(spark, d):
    m = bench.summarise(rel.bench_rows(spark, d)).groupBy("method").agg(F.round(F.avg("mean_miou"), 4).alias("v"))
    return bench.markdown_table(m, ["method", "v"], [F.col("v").desc(), F.col("method")])


_PARAMS = f"""WITH p AS (SELECT DISTINCT case_id, method, params FROM sweep_cases WHERE params IS NOT NULL AND method IS NOT NULL), k AS (SELECT case_id, method, params, unnest(map_keys(params)) AS k, unnest(map_values(params)) AS v FROM p),
t AS (SELECT case_id, method, params, string_agg(k || '_' || {_TOKEN % 'v'}, '__' ORDER BY k) AS l FROM k GROUP BY ALL)"""


@query(_PARAMS + " SELECT DISTINCT case_id, method || '__' || l AS label FROM t")
def case_labels(spark, d):
    c = table(spark, d, "sweep_cases").where("params IS NOT NULL AND size(params) > 0 AND method IS NOT NULL")
    return c.select("case_id", text.case_label(F.col("method"), F.col("params")).alias("label")).distinct()


@query(_PARAMS + " SELECT DISTINCT case_id, 'study__' || l AS label FROM t")
def study_labels(spark, d):
    c = table(spark, d, "sweep_cases").where("params IS NOT NULL AND size(params) > 0 AND method IS NOT NULL")
    return c.select("case_id", text.study_label(F.lit("study"), F.col("params")).alias("label")).distinct()


@query(f"""WITH {STEPS} SELECT run, CAST(step AS INTEGER) AS step, CASE step % 3 WHEN 0 THEN 'miou_gain' WHEN 1 THEN 'largest_error' ELSE 'unannotated' END AS mode FROM st""")
def mode_rotation(spark, d):
    return rel.steps(spark, d).select("run", "step", text.rotated(F.col("step"), ["miou_gain", "largest_error", "unannotated"]).alias("mode"))


@query("""WITH b AS (SELECT p_partkey AS id, least(greatest(p_size / 25.0 - 0.5, 0), 1) AS a, least(greatest((p_retailprice - 900) / 100, 0), 1) AS b FROM part)
SELECT id, round(least(a, 0.5), 6) AS x0, round(greatest(a, 0.5), 6) AS x1, least(a, 0.5) <= 0.6 AND greatest(a, 0.5) >= 0.4 AND least(b, 0.3) <= 0.5 AND greatest(b, 0.3) >= 0.2 AS meets FROM b""")
def box_normalise(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), geometry.box(F.col("p_size") / 25.0 - 0.5, (F.col("p_retailprice") - 900) / 100, F.lit(0.5), F.lit(0.3)).alias("b"))
    other = geometry.box(F.lit(0.4), F.lit(0.2), F.lit(0.6), F.lit(0.5))
    return _r(p.select("id", F.col("b.x0").alias("x0"), F.col("b.x1").alias("x1"), geometry.overlap(F.col("b"), other).isNotNull().alias("meets")), "x0", "x1")


@query("""WITH c AS (SELECT user_id % 10 AS cls, avg(value) / 500 AS iou, count(*) AS n, count(*) FILTER (event_type = 'error') AS fails FROM events GROUP BY 1)
SELECT cls, round((1 - iou) * 1.0 + 0.75 * (1 - iou) + 0.5 * fails / n + 0.2 / (1 + n) - 0.25 * (fails / n), 6) AS priority FROM c""")
def class_priority(spark, d):
    c = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("cls")).agg((F.avg("value") / 500).alias("iou"), F.count(F.lit(1)).alias("n_scribbles"), F.count_if(F.col("event_type") == "error").alias("fails"))
    state = c.select("cls", "iou", F.lit(1.0).alias("fragments"), (1 - F.col("iou")).alias("deficit"), (F.col("fails") / F.col("n_scribbles")).alias("bad"), "n_scribbles", (F.col("fails") / F.col("n_scribbles")).alias("failures"))
    return _r(region_priority(state).select("cls", "priority"), "priority")
