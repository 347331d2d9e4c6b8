"""Queries of pixels, regions, votes, quality, space, vectors and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.operators import graph, quality, spatial, strategies, vectors, votes
from tessela.plans import relations as rel
from tessela.sources import images
from tessela.sources.tables import table
from tessela.storage import materialise

PX = """px AS (SELECT l_linenumber AS image, l_suppkey AS sp, CAST(l_partkey % 3 AS INTEGER) AS gt, l_quantity / 10 AS lg0, l_discount * 50 AS lg1, l_tax * 60 AS lg2,
 l_returnflag <> 'N' AS valid, l_extendedprice / 1000 AS lab_l, l_discount * 100 AS lab_a, l_tax * 100 AS lab_b,
 CAST(CASE WHEN l_quantity / 10 >= greatest(l_discount * 50, l_tax * 60) THEN 0 WHEN l_discount * 50 >= l_tax * 60 THEN 1 ELSE 2 END AS INTEGER) AS pred FROM lineitem)"""
PROB = (
    PX
    + """, ex AS (SELECT *, exp(lg0 - greatest(lg0, lg1, lg2)) AS e0, exp(lg1 - greatest(lg0, lg1, lg2)) AS e1, exp(lg2 - greatest(lg0, lg1, lg2)) AS e2 FROM px),
pr AS (SELECT * EXCLUDE (e0, e1, e2), e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex),
cf AS (SELECT *, greatest(p0, p1, p2) AS conf, greatest(p0, p1, p2) - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2)) AS margin,
 -(p0 * ln(greatest(p0, 1e-8)) + p1 * ln(greatest(p1, 1e-8)) + p2 * ln(greatest(p2, 1e-8))) / ln(3.0) AS entropy FROM pr)"""
)
_ARG = "CAST(CASE WHEN s0 >= greatest(s1, s2) THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER)"
MEAN = PROB + f""", raw AS (SELECT image, sp, count(*) AS n, avg(p0) AS s0, avg(p1) AS s1, avg(p2) AS s2 FROM cf GROUP BY ALL), sc AS (SELECT *, {_ARG} AS sp_label FROM raw)"""
GRID = """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS rn FROM lineitem),
grid AS (SELECT l_linenumber AS image, rn % 64 AS x, rn // 64 AS y, l_suppkey AS sp, CAST(l_partkey % 3 AS INTEGER) AS gt FROM numbered)"""
EDGES = GRID + """, marked AS (SELECT *,
 coalesce(lag(sp) OVER r <> sp, false) OR coalesce(lead(sp) OVER r <> sp, false) OR coalesce(lag(sp) OVER c <> sp, false) OR coalesce(lead(sp) OVER c <> sp, false) AS se,
 coalesce(lag(gt) OVER r <> gt, false) OR coalesce(lead(gt) OVER r <> gt, false) OR coalesce(lag(gt) OVER c <> gt, false) OR coalesce(lead(gt) OVER c <> gt, false) AS ge
 FROM grid WINDOW r AS (PARTITION BY image, y ORDER BY x), c AS (PARTITION BY image, x ORDER BY y))"""
ADJ = GRID + """, nb AS (SELECT image, sp AS a, lead(sp) OVER (PARTITION BY image, y ORDER BY x) AS b FROM grid
 UNION ALL SELECT image, sp, lead(sp) OVER (PARTITION BY image, x ORDER BY y) FROM grid),
adj AS (SELECT image, least(a, b) AS u, greatest(a, b) AS v, count(*) AS w FROM nb WHERE a <> b GROUP BY ALL)"""
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


def _px(spark: SparkSession, d: str) -> DataFrame:
    return rel.pixels(spark, d)


def _prob(spark: SparkSession, d: str) -> DataFrame:
    return votes.confidence(votes.softmax(_px(spark, d)))


@query("WITH " + MEAN + """, out AS (SELECT cf.gt, CASE WHEN conf < 0.75 THEN sp_label ELSE pred END AS pred FROM cf JOIN sc USING (image, sp) WHERE valid)
SELECT gt, pred, count(*) AS n FROM out GROUP BY ALL""")
def sp_vote_confusion(spark, d):
    voted = votes.vote(_px(spark, d))
    return quality.confusion(voted.where("valid"), pred="label")


_LISTS = """li AS (SELECT DISTINCT '/imgs/p' || p_size || '_' || p_partkey % 7 || CASE WHEN p_partkey % 3 = 0 THEN '.JPG' WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '.png' END AS path FROM part),
lm AS (SELECT DISTINCT '/masks/p' || s_suppkey % 60 || '_' || s_suppkey % 11 || CASE WHEN s_suppkey % 2 = 0 THEN '.tif' ELSE '.png' END AS path FROM supplier),
im AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM li WHERE path NOT LIKE '%.txt'),
mk AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM lm)"""


def _listings(spark, d):
    c, text = F.col, lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    ext = F.when(c("p_partkey") % 3 == 0, ".JPG").when(c("p_partkey") % 5 == 0, ".txt").otherwise(".png")
    i = table(spark, d, "part").select(F.concat(F.lit("/imgs/p"), text("p_size"), F.lit("_"), text(c("p_partkey") % 7), ext).alias("path"))
    end = F.when(c("s_suppkey") % 2 == 0, ".tif").otherwise(".png")
    m = table(spark, d, "supplier").select(F.concat(F.lit("/masks/p"), text(c("s_suppkey") % 60), F.lit("_"), text(c("s_suppkey") % 11), end).alias("path"))
    return i, m


@query(f"""WITH {_LISTS} SELECT im.path AS image, arg_min(mk.path, {{'a': im.name <> mk.name, 'b': mk.path LIKE '%.tif', 'c': mk.path}}) AS mask FROM im JOIN mk USING (stem) GROUP BY im.path""")
def pair_inner(spark, d):
    return images.pair(*_listings(spark, d))


@query(f"WITH {_LISTS} SELECT path AS image FROM im WHERE stem NOT IN (SELECT stem FROM mk)")
def pair_unmatched(spark, d):
    i, m = _listings(spark, d)
    return images.images(i).select(F.col("path").alias("image")).join(images.pair(i, m), "image", "left_anti")


@query(f"""WITH {_LISTS}, a AS (SELECT stem, count(*) AS i FROM im GROUP BY stem), b AS (SELECT stem, count(*) AS m FROM mk GROUP BY stem),
p AS (SELECT stem, CASE WHEN i IS NULL THEN 'no image' WHEN m IS NULL THEN 'no mask' WHEN i > 1 OR m > 1 THEN 'repeated' END AS problem FROM a FULL JOIN b USING (stem)) SELECT * FROM p WHERE problem IS NOT NULL""")
def pair_symdiff(spark, d):
    return images.pairing_errors(*_listings(spark, d))


@query("SELECT coalesce(n_regionkey, -1) AS class_idx, l_suppkey IN (SELECT n_nationkey FROM nation) AS valid, count(*) AS n FROM lineitem LEFT JOIN nation ON l_suppkey = n_nationkey GROUP BY ALL")
def class_remap(spark, d):
    dim = table(spark, d, "nation").select(F.col("n_nationkey").alias("l_suppkey"), "n_regionkey")
    rows = table(spark, d, "lineitem").select("l_suppkey").join(dim, "l_suppkey", "left")
    return rows.groupBy(F.coalesce("n_regionkey", F.lit(-1)).alias("class_idx"), F.col("n_regionkey").isNotNull().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT DISTINCT l_linenumber AS image, l_suppkey AS code FROM lineitem), k AS (SELECT image, code, dense_rank() OVER (PARTITION BY image ORDER BY code) - 1 AS c FROM v)
SELECT image, code, CAST(c AS INTEGER) AS class_idx, list_transform(range(0, 5), lambda i: CAST(i = c AS INTEGER)) AS onehot FROM k WHERE c < 5""")
def class_onehot_dense(spark, d):
    codes = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("image"), F.col("l_suppkey").alias("sp")).distinct()
    dense = graph.relabel(codes).withColumn("class_idx", F.col("dense") - 1).where("class_idx < 5")
    onehot = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i == F.col("class_idx")).cast("int"))
    return dense.select("image", F.col("sp").alias("code"), "class_idx", onehot.alias("onehot"))


@query("WITH " + PX + " SELECT image, gt, pred, count(*) AS n FROM px WHERE valid GROUP BY ALL")
def confusion(spark, d):
    return quality.confusion(_px(spark, d).where("valid"), by=("image",))


_CLS = PX + """, cm AS (SELECT image, gt, pred, count(*) AS n FROM px WHERE valid GROUP BY ALL),
side AS (SELECT image, gt AS class, n AS g, 0 AS p, CASE WHEN gt = pred THEN n ELSE 0 END AS tp FROM cm UNION ALL SELECT image, pred, 0, n, 0 FROM cm),
cl AS (SELECT image, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) - sum(tp) AS BIGINT) AS fp, CAST(sum(g) - sum(tp) AS BIGINT) AS fn FROM side GROUP BY ALL)"""


@query("WITH " + _CLS + """, a AS (SELECT image, sum(CASE WHEN gt = pred THEN n ELSE 0 END) / sum(n) AS acc FROM cm GROUP BY ALL)
SELECT image, round(acc, 6) AS accuracy, round(avg(tp / (tp + fp + fn)), 6) AS miou FROM cl JOIN a USING (image) GROUP BY image, acc""")
def confusion_metrics(spark, d):
    return _r(quality.summary(quality.confusion(_px(spark, d).where("valid"), by=("image",)), ("image",)), "accuracy", "miou")


@query("WITH " + _CLS + " SELECT image, class, tp, fp, fn, round(tp / (tp + fp + fn), 6) AS iou FROM cl")
def per_class_iou(spark, d):
    return _r(quality.class_metrics(quality.confusion(_px(spark, d).where("valid"), by=("image",)), ("image",)), "iou")


@query("WITH " + PX + " SELECT image, round(avg(CAST(gt = pred AS INTEGER)), 6) AS accuracy FROM px GROUP BY image")
def pixel_accuracy(spark, d):
    return _r(_px(spark, d).groupBy("image").agg(F.avg((F.col("gt") == F.col("pred")).cast("int")).alias("accuracy")), "accuracy")


@query("WITH " + PX + """ SELECT image, count(*) AS total_px, count(*) FILTER (valid) AS annotated_px, count(*) FILTER (valid AND gt = pred) AS correct_px,
 round(count(*) FILTER (valid) / count(*), 6) AS coverage, round(count(*) FILTER (valid AND gt = pred) / count(*) FILTER (valid), 6) AS precision FROM px GROUP BY image""")
def step_metrics(spark, d):
    known = _px(spark, d).withColumn("pred", F.when(F.col("valid"), F.col("pred")).otherwise(-1))
    return _r(quality.step_metrics(known), "coverage", "precision")


@query("""WITH s AS (SELECT DISTINCT * EXCLUDE (ingested_at, per_class_iou, per_class_n_scribbles, per_class_ink_px) FROM step_metrics WHERE miou IS NOT NULL AND NOT isnan(miou))
SELECT image, count(*) AS n, round(avg(miou / greatest(n_scribbles, 1)), 6) AS miou_per_scribble, round(avg(miou / greatest(1e-6, total_ink_px / 1000)), 6) AS miou_per_1kpx,
 round(avg(correctly_annotated_px / greatest(n_scribbles, 1)), 4) AS correct_px_per_scribble, round(avg(correctly_annotated_px / greatest(1e-6, total_ink_px)), 4) AS correct_px_per_px_ink,
 round(avg(miou * coverage) FILTER (NOT isnan(coverage)), 6) AS quality_x_coverage FROM s WHERE total_ink_px IS NOT NULL AND NOT isnan(total_ink_px) AND n_scribbles IS NOT NULL GROUP BY image""")
def step_efficiency(spark, d):
    s = table(spark, d, "step_metrics").drop("ingested_at", "per_class_iou", "per_class_n_scribbles", "per_class_ink_px").where("miou IS NOT NULL AND NOT isnan(miou)")
    e = quality.efficiency(s.distinct()).where("total_ink_px IS NOT NULL AND NOT isnan(total_ink_px) AND n_scribbles IS NOT NULL")
    names = ("miou_per_scribble", "miou_per_1kpx", "correct_px_per_scribble", "correct_px_per_px_ink", "quality_x_coverage")
    out = e.groupBy("image").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in names])
    return _r(_r(out, "miou_per_scribble", "miou_per_1kpx", "quality_x_coverage"), "correct_px_per_scribble", "correct_px_per_px_ink", to=4)


@query("WITH " + _CLS + """ SELECT image, round(max(CASE WHEN class = 0 THEN tp / (tp + fp + fn) END), 6) AS iou_0, round(max(CASE WHEN class = 1 THEN tp / (tp + fp + fn) END), 6) AS iou_1,
 round(max(CASE WHEN class = 2 THEN tp / (tp + fp + fn) END), 6) AS iou_2 FROM cl GROUP BY image""")
def step_metrics_wide(spark, d):
    cls = quality.class_metrics(quality.confusion(_px(spark, d).where("valid"), by=("image",)), ("image",))
    wide = cls.withColumn("class", F.concat(F.lit("iou_"), F.col("class").cast("string"))).groupBy("image").pivot("class", ["iou_0", "iou_1", "iou_2"]).agg(F.first("iou"))
    return _r(wide, "iou_0", "iou_1", "iou_2")


@query("WITH " + PX + """ SELECT image, sp, round(CASE WHEN count(*) FILTER (gt = 1 OR pred = 1) > 0 THEN count(*) FILTER (gt = 1 AND pred = 1) / count(*) FILTER (gt = 1 OR pred = 1) ELSE 0 END, 6) AS iou
 FROM px GROUP BY image, sp""")
def binary_iou_pairs(spark, d):
    return _r(_px(spark, d).groupBy("image", "sp").agg(quality.binary_iou(F.col("gt") == 1, F.col("pred") == 1).alias("iou")), "iou")


@query("WITH " + PX + """, c AS (SELECT image, sp AS class, count(*) AS n FROM px GROUP BY ALL), z AS (SELECT image, sum(n) AS size FROM c GROUP BY image),
full_ AS (SELECT k.class, z.image, coalesce(c.n, 0) / z.size AS share, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT class FROM c) k CROSS JOIN z LEFT JOIN c ON c.class = k.class AND c.image = z.image)
SELECT class, round(sum(n) / (SELECT sum(size) FROM z), 6) AS global_share, round(avg(share), 6) AS mean_share, round(stddev_pop(share), 6) AS std_share,
 round(avg(share) FILTER (n > 0), 6) AS mean_present, count(*) FILTER (n > 0) AS present_images FROM full_ GROUP BY class""")
def mask_class_percentages(spark, d):
    return _r(quality.class_shares(_px(spark, d), "sp"), "global_share", "mean_share", "std_share", "mean_present")


@query("WITH " + PX + """ SELECT image, sp, count(*) AS n, round(avg(lab_l), 5) AS mean_lab_l, round(avg(lab_a), 5) AS mean_lab_a, round(avg(lab_b), 5) AS mean_lab_b,
 round(var_pop(lab_l), 9) AS var_lab_l, round(var_pop(lab_a), 9) AS var_lab_a, round(var_pop(lab_b), 9) AS var_lab_b FROM px GROUP BY ALL""")
def sp_stats_meanvar(spark, d):
    stats = quality.region_stats(_px(spark, d))
    return _r(_r(stats, *[c for c in stats.columns if c[:4] == "mean"], to=5), *[c for c in stats.columns if c[:4] == "var_"], to=9)


def _scores(mode, prior_power):
    def run(spark, d):
        return _r(votes.region_scores(_prob(spark, d), mode, prior_power=prior_power), "s0", "s1", "s2")

    return run


_OUT = f"SELECT image, sp, n, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, {_ARG} AS sp_label FROM sc"
for _name, _mode, _sql in (
    ("sp_mean_proba", "mean_proba", "sc AS (SELECT image, sp, count(*) AS n, avg(p0) AS s0, avg(p1) AS s1, avg(p2) AS s2 FROM cf GROUP BY ALL)"),
    ("sp_weighted_conf", "confidence_weighted_mean", "W(conf)"),
    ("sp_weighted_margin", "margin_weighted_mean", "W(margin)"),
    ("sp_weighted_entropy", "entropy_weighted_mean", "W(1 - entropy)"),
    ("sp_logit_mean", "logit_mean", """m AS (SELECT image, sp, count(*) AS n, avg(lg0) AS a, avg(lg1) AS b, avg(lg2) AS c FROM cf GROUP BY ALL),
 e AS (SELECT *, exp(a - greatest(a, b, c)) AS x, exp(b - greatest(a, b, c)) AS y, exp(c - greatest(a, b, c)) AS z FROM m), sc AS (SELECT image, sp, n, x / (x + y + z) AS s0, y / (x + y + z) AS s1, z / (x + y + z) AS s2 FROM e)"""),
    ("sp_prior_corrected", "mean_proba", """m AS (SELECT image, sp, count(*) AS n, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c FROM cf GROUP BY ALL),
 q AS (SELECT image, avg(p0) AS u, avg(p1) AS v, avg(p2) AS w FROM cf GROUP BY ALL), e AS (SELECT m.*, a / sqrt(u) AS x, b / sqrt(v) AS y, c / sqrt(w) AS z FROM m JOIN q USING (image)),
 sc AS (SELECT image, sp, n, x / (x + y + z) AS s0, y / (x + y + z) AS s1, z / (x + y + z) AS s2 FROM e)"""),
):
    if _sql.startswith("W("):
        _w = f"greatest({_sql[2:-1]}, 1e-6)"
        _sql = f"sc AS (SELECT image, sp, count(*) AS n, sum(p0 * {_w}) / sum({_w}) AS s0, sum(p1 * {_w}) / sum({_w}) AS s1, sum(p2 * {_w}) / sum({_w}) AS s2 FROM cf GROUP BY ALL)"
    QUERIES[_name] = _scores(_mode, 0.5 if _name == "sp_prior_corrected" else 0.0)
    ORACLE[_name] = f"WITH {PROB}, {_sql} {_OUT}"


@query("WITH " + PX + """, c AS (SELECT image, sp, pred, count(*) AS votes FROM px GROUP BY ALL) SELECT image, sp, pred AS sp_label, votes FROM c
 QUALIFY row_number() OVER (PARTITION BY image, sp ORDER BY votes DESC, pred) = 1""")
def sp_majority_label(spark, d):
    return votes.majority(_px(spark, d))


@query("WITH " + PROB + " SELECT image, pred, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(margin), 6) AS margin, round(avg(entropy), 6) AS entropy FROM cf GROUP BY ALL")
def pixel_confidence(spark, d):
    out = _prob(spark, d).groupBy("image", "pred").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("conf", "margin", "entropy")])
    return _r(out, "conf", "margin", "entropy")


@query("WITH " + PROB + """, t AS (SELECT image, pow(p0, 0.5) AS a, pow(p1, 0.5) AS b, pow(p2, 0.5) AS c FROM (SELECT image, greatest(p0, 1e-8) AS p0, greatest(p1, 1e-8) AS p1, greatest(p2, 1e-8) AS p2 FROM cf))
 SELECT image, round(avg(a / (a + b + c)), 6) AS p0, round(avg(b / (a + b + c)), 6) AS p1, round(avg(c / (a + b + c)), 6) AS p2 FROM t GROUP BY image""")
def temperature_probs(spark, d):
    out = votes.temper(_prob(spark, d), 2.0).groupBy("image").agg(*[F.avg(f"p{i}").alias(f"p{i}") for i in range(3)])
    return _r(out, "p0", "p1", "p2")


_ACC = MEAN + """, j AS (SELECT cf.*, s0, s1, s2, sp_label, greatest(s0, s1, s2) AS sp_conf FROM cf JOIN sc USING (image, sp)),
ac AS (SELECT image, sp, any_value(sp_conf) AS top, any_value(2 * sp_conf + least(s0, s1, s2) - s0 - s1 - s2) AS gap, avg(CAST(sp_label <> pred AS INTEGER)) AS share, avg(conf) FILTER (sp_label <> pred) AS cc FROM j GROUP BY ALL)"""


@query("WITH " + _ACC + " SELECT image, sp, gap >= 0.05 AND top >= 0.4 AND share <= 0.6 AND coalesce(cc, 0) <= 0.9 AS accept FROM ac")
def sp_accept_mask(spark, d):
    px = _prob(spark, d)
    joined = px.join(votes.region_scores(px).drop("n"), ["image", "sp"])
    return votes.accept(joined, min_margin=0.05, min_conf=0.4, max_changed=0.6, max_changed_conf=0.9)


def _overwrite(policy):
    def run(spark, d):
        return quality.confusion(votes.vote(_px(spark, d), policy=policy).where("valid"), pred="label", by=("image",))

    return run


_BASE = """, mv AS (SELECT image, sp, pred AS base_label FROM (SELECT image, sp, pred, count(*) AS votes FROM px GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image, sp ORDER BY votes DESC, pred) = 1)"""
for _name, _policy, _when in (
    ("overwrite_all", "all", "true"), ("overwrite_low", "low_pixel_conf", "conf < 0.75"), ("overwrite_disagree", "disagree_low_pixel_conf", "sp_label <> pred AND conf < 0.75"),
    ("overwrite_high", "high_sp_conf", "sp_conf >= 0.75"), ("overwrite_changed", "changed_high_sp_conf", "base_label <> sp_label AND sp_conf >= 0.75"),
):
    QUERIES[_name] = _overwrite(_policy)
    ORACLE[_name] = f"WITH {_ACC}{_BASE} SELECT image, gt, CASE WHEN {_when} THEN sp_label ELSE pred END AS pred, count(*) AS n FROM j JOIN mv USING (image, sp) WHERE valid GROUP BY ALL"


@query("WITH " + _ACC + """ SELECT image, gt, CASE WHEN conf < 0.75 AND gap >= 0.05 AND share <= 0.6 THEN sp_label ELSE pred END AS pred, count(*) AS n FROM j JOIN ac USING (image, sp) WHERE valid GROUP BY ALL""")
def guarded_vote(spark, d):
    voted = votes.vote(_px(spark, d), guards={"min_margin": 0.05, "max_changed": 0.6})
    return quality.confusion(voted.where("valid"), pred="label", by=("image",))


_SHARES = ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, {r[3]}, {r[4]})" for r in (line.split() for line in strategies.RECIPES.strip().splitlines()))


@query(f"""WITH r AS (SELECT *, row_number() OVER () AS i FROM (VALUES {_SHARES}) v(family, aggregate_mode, temperature, prior_power, weight_power)),
p(j, overwrite_policy, pixel, region, graph_steps, graph_alpha, cleanup_mode, small) AS (VALUES (1, 'all', 0.75, 0.75, 0, 0.0, 'none', 3), (2, 'low_pixel_conf', 0.6, 0.75, 0, 0.0, 'none', 3),
 (3, 'low_pixel_conf', 0.75, 0.75, 1, 0.2, 'none', 3), (4, 'disagree_low_pixel_conf', 0.7, 0.75, 1, 0.35, 'simple', 2), (5, 'high_sp_conf', 0.75, 0.65, 2, 0.25, 'conservative', 3))
SELECT printf('novel_%02d_%02d', i, j) AS strategy_id, family, aggregate_mode, overwrite_policy, CAST(pixel AS DOUBLE) AS pixel_confidence_threshold, CAST(region AS DOUBLE) AS superpixel_confidence_threshold,
 CAST(prior_power AS DOUBLE) AS prior_power, CAST(temperature AS DOUBLE) AS temperature, CAST(weight_power AS DOUBLE) AS weight_power, graph_steps, CAST(graph_alpha AS DOUBLE) AS graph_alpha, cleanup_mode,
 small AS small_component_superpixels, CAST(0.6 AS DOUBLE) AS neighbor_ratio_threshold, CAST(0 AS DOUBLE) AS min_superpixel_margin, CAST(1 AS DOUBLE) AS max_change_fraction, CAST(1 AS DOUBLE) AS max_changed_mean_confidence,
 false AS enforce_superpixel_confidence_guard FROM r, p""")
def strategy_catalog(spark, d):
    return strategies.catalog(spark).where("name LIKE 'novel%'").drop("name")


_MODE_LABELS = (
    ("mean_proba", "avg(p{i})"), ("majority_argmax", "count(*) FILTER (pred = {i})"), ("logit_mean", "avg(lg{i})"), ("confidence_weighted_mean", "sum(p{i} * greatest(conf, 1e-6)) / sum(greatest(conf, 1e-6))"),
    ("margin_weighted_mean", "sum(p{i} * greatest(margin, 1e-6)) / sum(greatest(margin, 1e-6))"), ("entropy_weighted_mean", "sum(p{i} * greatest(1 - entropy, 1e-6)) / sum(greatest(1 - entropy, 1e-6))"),
)
_VOTES = " UNION ALL ".join(f"SELECT image, sp, {', '.join(sql.format(i=i) + f' AS s{i}' for i in range(3))}, '{mode}' AS mode FROM cf GROUP BY image, sp" for mode, sql in _MODE_LABELS)


@query("WITH " + PROB + f""", v AS ({_VOTES}),
cells AS (SELECT mode, gt, CASE WHEN conf < 0.75 THEN {_ARG} ELSE pred END AS pred, count(*) AS n FROM cf JOIN v USING (image, sp) WHERE valid GROUP BY ALL
 UNION ALL SELECT 'baseline', gt, pred, count(*) FROM cf WHERE valid GROUP BY ALL),
side AS (SELECT mode, gt AS class, n AS g, 0 AS p, CASE WHEN gt = pred THEN n ELSE 0 END AS tp FROM cells UNION ALL SELECT mode, pred, 0, n, 0 FROM cells),
iou AS (SELECT mode, class, sum(tp) / (sum(p) + sum(g) - sum(tp)) AS iou FROM side GROUP BY ALL), mi AS (SELECT mode, avg(iou) AS miou FROM iou GROUP BY mode),
a AS (SELECT mode, sum(CASE WHEN gt = pred THEN n ELSE 0 END) / sum(n) AS accuracy FROM cells GROUP BY mode)
SELECT mode, round(accuracy, 6) AS accuracy, round(miou, 6) AS miou, round(miou - (SELECT miou FROM mi WHERE mode = 'baseline'), 6) AS d_miou FROM a JOIN mi USING (mode)""")
def strategy_compare(spark, d):
    return _r(strategies.compare(_px(spark, d)), "accuracy", "miou", "d_miou")


def _refined(strategy_id):
    def run(spark, d):
        s, px = strategies.resolve(strategy_id), rel.grid_pixels(spark, d)
        if strategies.uses_edges(s):
            px = materialise(px.repartition("image", "sp"), "pixels")  # placed once; the pixels of a region side by side
        out = strategies.refine(px, s, quality.adjacency(px))
        return quality.confusion(out, pred="label", by=("image",))

    return run


# Whole strategies: temperature and smoothing by SQL; with cleanup against brute force in the tests.
for _name in ("novel_05_01", "novel_12_02", "novel_20_04", "novel_09_05", "safe_non_degrading", "legacy_hybrid_conservative"):
    QUERIES[f"refine_{_name}"] = _refined(_name)
_P15 = ", ".join(f"avg(p{i}) AS s{i}" for i in range(3))
ORACLE["refine_novel_05_01"] = f"""WITH {PROB}, m AS (SELECT image, sp, {_P15} FROM cf GROUP BY ALL), q AS (SELECT image, avg(p0) AS u, avg(p1) AS v, avg(p2) AS w FROM cf GROUP BY image),
v AS (SELECT image, sp, s0 / sqrt(u) AS s0, s1 / sqrt(v) AS s1, s2 / sqrt(w) AS s2 FROM m JOIN q USING (image)) SELECT image, gt, {_ARG} AS pred, count(*) AS n FROM cf JOIN v USING (image, sp) GROUP BY ALL"""
_W2 = ", ".join(f"sum(p{i} * conf * conf) / sum(conf * conf) AS s{i}" for i in range(3))
ORACLE["refine_novel_12_02"] = f"""WITH {PROB}, v AS (SELECT image, sp, {_W2} FROM cf GROUP BY ALL) SELECT image, gt, CASE WHEN conf < 0.6 THEN {_ARG} ELSE pred END AS pred, count(*) AS n FROM cf JOIN v USING (image, sp) GROUP BY ALL"""


_THRESH = "WITH " + MEAN + """, t AS (SELECT CAST(unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS threshold), cells AS (SELECT threshold, gt, CASE WHEN conf < threshold THEN sp_label ELSE pred END AS pred, count(*) AS n
 FROM cf JOIN sc USING (image, sp), t WHERE valid GROUP BY ALL),
side AS (SELECT threshold, gt AS class, n AS g, 0 AS p, CASE WHEN gt = pred THEN n ELSE 0 END AS tp FROM cells UNION ALL SELECT threshold, pred, 0, n, 0 FROM cells),
iou AS (SELECT threshold, class, sum(tp) / (sum(p) + sum(g) - sum(tp)) AS iou FROM side GROUP BY ALL), a AS (SELECT threshold, sum(CASE WHEN gt = pred THEN n ELSE 0 END) / sum(n) AS accuracy FROM cells GROUP BY threshold),
swept AS (SELECT threshold, round(accuracy, 6) AS accuracy, round(avg(iou), 6) AS miou FROM a JOIN iou USING (threshold) GROUP BY threshold, accuracy) """


@query(_THRESH + "SELECT * FROM swept")
def threshold_sweep(spark, d):
    return _r(strategies.threshold_sweep(_px(spark, d), [0.5, 0.6, 0.7, 0.8, 0.9]), "accuracy", "miou")


@query(_THRESH + """, top AS (SELECT max(accuracy) AS best FROM swept) SELECT swept.* FROM swept, top WHERE accuracy >= best - 0.01 ORDER BY miou DESC, accuracy DESC, threshold LIMIT 1""")
def safe_best(spark, d):
    swept = threshold_sweep(spark, d)
    top = swept.agg(F.max("accuracy").alias("best"))
    return swept.join(F.broadcast(top)).where("accuracy >= best - 0.01").drop("best").orderBy(F.desc("miou"), F.desc("accuracy"), "threshold").limit(1)


@query("WITH " + PX + """, c AS (SELECT image, sp, gt, count(*) AS n FROM px GROUP BY ALL), m AS (SELECT image, sp, max(n) AS top, sum(n) AS n FROM c GROUP BY ALL)
SELECT image, round(sum(top) / sum(n), 6) AS asa FROM m GROUP BY image""")
def asa(spark, d):
    return _r(quality.achievable_accuracy(_px(spark, d)), "asa")


@query("WITH " + PX + """, c AS (SELECT image, sp, gt, count(*) AS n FROM px GROUP BY ALL), z AS (SELECT image, sp, sum(n) AS size FROM c GROUP BY ALL)
SELECT image, round((sum(size) - sum(n)) / sum(n), 6) AS ue FROM c JOIN z USING (image, sp) GROUP BY image""")
def undersegmentation(spark, d):
    return _r(quality.undersegmentation(_px(spark, d)), "ue")


@query("WITH " + EDGES + """, s AS (SELECT image, sp, count(*) AS a, count(*) FILTER (se) AS p FROM marked GROUP BY ALL)
SELECT image, round(avg(least(1.0, 4 * pi() * a / (p * p))), 6) AS compactness FROM s WHERE p > 0 GROUP BY image""")
def compactness(spark, d):
    return _r(quality.compactness(rel.grid(spark, d)), "compactness")


@query("WITH " + EDGES + """, near AS (SELECT DISTINCT image, x + dx AS x, y + dy AS y FROM marked, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE se)
SELECT image, round(avg(CASE WHEN near.x IS NOT NULL THEN 1 ELSE 0 END), 6) AS recall FROM marked LEFT JOIN near USING (image, x, y) WHERE ge GROUP BY image""")
def boundary_recall(spark, d):
    return _r(quality.boundary_recall(rel.grid(spark, d)), "recall")


@query("WITH " + EDGES + " SELECT image, sp, count(*) AS n, count(*) FILTER (se) AS boundary FROM marked GROUP BY ALL")
def boundary_pixels(spark, d):
    g = rel.grid(spark, d)
    return g.withColumn("edge", quality.edges(g, "sp")).groupBy("image", "sp").agg(F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("boundary"))


@query("WITH " + ADJ + " SELECT * FROM adj")
def sp_adjacency(spark, d):
    return quality.adjacency(rel.grid(spark, d))


def _smooth_sql(rounds: int) -> str:
    parts, at = [], "s_0"
    for i in range(1, rounds + 1):
        parts.append(f"""n_{i} AS (SELECT b.image, b.u AS sp, sum(w) AS w, sum(s0 * w) AS n0, sum(s1 * w) AS n1, sum(s2 * w) AS n2 FROM both_ b JOIN {at} s ON s.image = b.image AND s.sp = b.v GROUP BY ALL),
m_{i} AS (SELECT s.image, s.sp, CASE WHEN w > 0 THEN 0.7 * s0 + 0.3 * n0 / w ELSE s0 END AS s0, CASE WHEN w > 0 THEN 0.7 * s1 + 0.3 * n1 / w ELSE s1 END AS s1, CASE WHEN w > 0 THEN 0.7 * s2 + 0.3 * n2 / w ELSE s2 END AS s2
 FROM {at} s LEFT JOIN n_{i} USING (image, sp)), s_{i} AS (SELECT image, sp, s0 / (s0 + s1 + s2) AS s0, s1 / (s0 + s1 + s2) AS s1, s2 / (s0 + s1 + s2) AS s2 FROM m_{i})""")
        at = f"s_{i}"
    return f"WITH {MEAN}, {ADJ}, both_ AS (SELECT image, u, v, w FROM adj UNION ALL SELECT image, v, u, w FROM adj), s_0 AS (SELECT image, sp, s0, s1, s2 FROM sc), {', '.join(parts)} SELECT image, sp, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM {at}"


@query(_smooth_sql(2))
def graph_smooth(spark, d):
    scores = votes.region_scores(_prob(spark, d)).select("image", "sp", "s0", "s1", "s2")
    return _r(graph.smooth(scores, quality.adjacency(rel.grid(spark, d)), 2, 0.3), "s0", "s1", "s2")


_CC = "lk AS (SELECT CAST(c_nationkey AS BIGINT) AS image, c_custkey AS u, (c_custkey * 7 + 3) % 1500 AS v FROM customer)"


@query(f"""WITH RECURSIVE {_CC}, e AS (SELECT u, v FROM lk UNION SELECT v, u FROM lk), n AS (SELECT DISTINCT u AS node FROM e),
w(node, seen) AS (SELECT node, node FROM n UNION SELECT w.node, e.v FROM w JOIN e ON e.u = w.seen) SELECT node, min(seen) AS comp FROM w GROUP BY node""")
def connected_components(spark, d):
    links = table(spark, d, "customer").select(F.lit(0).alias("image"), F.col("c_custkey").alias("u"), ((F.col("c_custkey") * 7 + 3) % 1500).alias("v"))
    nodes = links.select("image", F.col("u").alias("node")).unionByName(links.select("image", F.col("v").alias("node")))
    return graph.components(nodes, links).select("node", "comp")


@query()
def cleanup_components(spark, d):
    labels = votes.region_scores(_prob(spark, d)).select("image", "sp", F.col("sp_label").alias("label"))
    return graph.cleanup(labels, quality.adjacency(rel.grid(spark, d)), 2)


@query("WITH " + PX + " SELECT DISTINCT image, sp, CAST(dense_rank() OVER (PARTITION BY image ORDER BY sp) AS INTEGER) AS dense FROM px")
def relabel_sequential(spark, d):
    return graph.relabel(_px(spark, d).select("image", "sp").distinct())


_BOX = "boxes AS (SELECT p_partkey AS id, p_size / 50.0 AS x0, p_size / 50.0 + 0.02 AS x1, (p_retailprice - 900) / 100.0 AS y0, (p_retailprice - 900) / 100.0 + 0.02 AS y1 FROM part)"


@query(f"WITH {_BOX} SELECT a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0")
def bbox_overlap_pairs(spark, d):
    b = rel.boxes(spark, d)
    return spatial.box_join(b, b, 0.04, ordered=True)


_EMB = "e AS (SELECT vec_id AS sp, label AS code, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS emb FROM embeddings), g AS (SELECT *, emb[1] AS cx, emb[2] AS cy FROM e)"
_UNIT = "u AS (SELECT sp, code, cx, cy, list_transform(emb, lambda x: x / greatest(sqrt(list_sum(list_transform(emb, lambda y: y * y))), 1e-8)) AS emb FROM g)"
_PROTO = _EMB + ", " + _UNIT + """, ps AS (SELECT code, unnest(emb) AS v, unnest(range(len(emb))) AS pos FROM u), mp AS (SELECT code, pos, avg(v) AS v FROM ps GROUP BY ALL),
nr AS (SELECT code, sqrt(sum(v * v)) AS n FROM mp GROUP BY code), pt AS (SELECT code, pos, v / n AS v FROM mp JOIN nr USING (code))"""


@query(f"WITH {_EMB} SELECT a.sp AS a_id, b.sp AS b_id, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 5) AS dist FROM g a JOIN g b ON a.sp < b.sp AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 0.02")
def radius_neighbors(spark, d):
    pts = rel.region_vectors(spark, d).select(F.col("sp").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return _r(spatial.radius_join(pts, pts, 0.02).where("a_id < b_id"), "dist", to=5)


@query(f"WITH {_PROTO} SELECT code, CAST(pos AS INTEGER) AS pos, round(v, 5) AS v FROM pt")
def class_prototype(spark, d):
    protos = vectors.prototypes(rel.region_vectors(spark, d))
    return _r(protos.select("code", F.posexplode("prototype").alias("pos", "v")), "v", to=5)


@query(f"WITH {_PROTO}, cs AS (SELECT sp, code, sum(ps2.v * pt.v) AS cosine FROM (SELECT sp, code, unnest(emb) AS v, unnest(range(len(emb))) AS pos FROM u) ps2 JOIN pt USING (code, pos) GROUP BY ALL) SELECT sp, code, round(cosine, 5) AS cosine FROM cs WHERE cosine >= 0.2")
def cosine_gate(spark, d):
    v = rel.region_vectors(spark, d)
    return _r(vectors.cosine_gate(v, vectors.prototypes(v), 0.2).select("sp", "code", "cosine"), "cosine", to=5)


_LINF = "CAST(greatest(0, least(1, 1 - list_max(list_transform(list_zip(a.emb, b.emb), lambda z: abs(z[1] - z[2]))) / {limit})) AS DOUBLE)"


@query(f"WITH {_EMB} SELECT a.sp AS a_id, b.sp AS b_id, round({_LINF.format(limit=0.5)}, 5) AS score FROM g a JOIN g b ON b.sp = a.sp + 1")
def linf_similarity(spark, d):
    v = rel.region_vectors(spark, d)
    a, b = v.select(F.col("sp").alias("a_id"), F.col("emb").alias("a")), v.select((F.col("sp") - 1).alias("a_id"), F.col("sp").alias("b_id"), F.col("emb").alias("b"))
    return _r(a.join(b, "a_id").select("a_id", "b_id", vectors.chebyshev_similarity(F.col("a"), F.col("b"), 0.5).alias("score")), "score", to=5)


@query(f"""WITH {_EMB}, sd AS (SELECT * FROM g WHERE sp % 20 = 0), p AS (SELECT b.sp, a.sp AS seed, a.code, {_LINF.format(limit=0.6)} AS score FROM sd a JOIN g b ON b.sp % 20 <> 0
 AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 0.08)
SELECT sp, seed, code, round(score, 5) AS score FROM p WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY sp ORDER BY score DESC, seed) = 1""")
def propagate_one_hop(spark, d):
    v = rel.region_vectors(spark, d)
    return _r(vectors.propagate(v, v.where("sp % 20 = 0"), 0.08, 0.6, 0.3), "score", to=5)


@query("WITH " + PX + ", m AS (SELECT gt, pred, count(*) AS n FROM px WHERE gt > 0 OR pred > 0 GROUP BY ALL) SELECT CASE WHEN gt > 0 AND pred = 0 THEN 'FN' WHEN gt = 0 AND pred > 0 THEN 'FP' WHEN gt <> pred THEN 'swap' ELSE 'OK' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1")
def error_map(spark, d):
    c = F.col
    kind = F.when((c("gt") > 0) & (c("pred") == 0), "FN").when((c("gt") == 0) & (c("pred") > 0), "FP").when(c("gt") != c("pred"), "swap").otherwise("OK")
    return _px(spark, d).where("gt > 0 OR pred > 0").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linenumber AS image, l_suppkey AS sp, round(quantile_cont(l_extendedprice, 0.8), 4) AS q80 FROM lineitem GROUP BY ALL")
def quantile_core(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("image"), F.col("l_suppkey").alias("sp"))
    return _r(t.agg(F.percentile("l_extendedprice", F.lit(0.8)).alias("q80")), "q80", to=4)


@query("WITH " + PX + ", q AS (SELECT image, sp, avg(lab_l) AS m FROM px GROUP BY ALL) SELECT px.image, round(avg((lab_l - m) * (lab_l - m)), 4) AS mse FROM px JOIN q USING (image, sp) GROUP BY px.image")
def hard_reconstruction(spark, d):
    px = _px(spark, d)
    means = px.groupBy("image", "sp").agg(F.avg("lab_l").alias("m"))
    return _r(px.join(means, ["image", "sp"]).groupBy("image").agg(F.avg((F.col("lab_l") - F.col("m")) ** 2).alias("mse")), "mse", to=4)


@query("WITH " + GRID + " SELECT image, x // 8 AS cx, y // 8 AS cy, count(*) AS n, round(avg(x), 5) AS mx, round(avg(y), 5) AS my FROM grid GROUP BY ALL")
def grid_centroids(spark, d):
    g = rel.grid(spark, d)
    out = g.groupBy("image", F.floor(F.col("x") / 8).alias("cx"), F.floor(F.col("y") / 8).alias("cy"))
    return _r(out.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")), "mx", "my", to=5)


@query("WITH " + GRID + """, k AS (SELECT image, y, x, gt, sum(CAST(coalesce(lag_gt <> gt, true) AS INTEGER)) OVER (PARTITION BY image, y ORDER BY x) AS run FROM
 (SELECT *, lag(gt) OVER (PARTITION BY image, y ORDER BY x) AS lag_gt FROM grid)) SELECT image, CAST(y AS INTEGER) AS y, gt, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) AS INTEGER) AS x1 FROM k GROUP BY image, y, gt, run""")
def row_runs(spark, d):
    """Run-length encoding of the rows of a mask: the first step from labels to polygons."""
    w = Window.partitionBy("image", "y").orderBy("x")
    g = rel.grid(spark, d).withColumn("new", F.coalesce((F.lag("gt").over(w) != F.col("gt")).cast("int"), F.lit(1)))
    return g.withColumn("run", F.sum("new").over(w)).groupBy("image", "y", "gt", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")
