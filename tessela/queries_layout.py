"""Queries of colours, masks, soft segments, layouts, prompts, configs and saved states, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessela.functions import colour, geometry, layout, prompts
from tessela.operators import bench, events, quality, raster, regions, soft
from tessela.plans import relations as rel
from tessela.queries_bench import STEPS
from tessela.queries_data import _OPEN
from tessela.queries_regions import _CLS, GRID
from tessela.sources import logs, masks, states
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


# Colours and classes

_RGB = "c AS (SELECT p_partkey AS id, p_size / 50.0 AS r, least(1.0, (p_retailprice - 900) / 1200.0) AS g, p_partkey % 256 / 255.0 AS b FROM part)"
_LIN = "CASE WHEN v{0} > 0.04045 THEN pow((v{0} + 0.055) / 1.055, 2.4) ELSE v{0} / 12.92 END AS l{0}"
_LAB = f"""{_RGB}, q AS (SELECT id, {', '.join(f'floor(least(greatest({c} * 255, 0), 255)) / 255 AS v{c}' for c in 'rgb')} FROM c), n AS (SELECT id, {', '.join(_LIN.format(c) for c in 'rgb')} FROM q),
x AS (SELECT id, {', '.join(f'({row[0]} * lr + {row[1]} * lg + {row[2]} * lb) / {w} AS {name}' for row, w, name in zip(colour.TO_XYZ, colour.WHITE, 'xyz'))} FROM n),
f AS (SELECT id, y, {', '.join(f'CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + 16 / 116 END AS f{c}' for c in 'xyz')} FROM x),
lab AS (SELECT id, round_even(least(greatest(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END * 2.55, 0), 255), 0) / 2.55 AS l,
 round_even(least(greatest(500 * (fx - fy) + 128, 0), 255), 0) - 128 AS a, round_even(least(greatest(200 * (fy - fz) + 128, 0), 255), 0) - 128 AS b FROM f)"""


def _rgb(spark, d):
    c = F.col
    return table(spark, d, "part").select(c("p_partkey").alias("id"), (c("p_size") / 50.0).alias("r"), F.least(F.lit(1.0), (c("p_retailprice") - 900) / 1200.0).alias("g"), (c("p_partkey") % 256 / 255.0).alias("b"))


@query(f"WITH {_LAB} SELECT id, round(l, 5) AS l, a, b FROM lab")
def lab_colours(spark, d):
    return _r(_rgb(spark, d).select("id", colour.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("v")).select("id", "v.*"), "l", to=5)


@query(f"""WITH {_LAB}, k AS (SELECT id, floor(l * 2.55) / 2.55 AS l, a, b FROM lab), y AS (SELECT *, CASE WHEN l <= 8 THEN l / 903.3 ELSE pow((l + 16) / 116, 3) END AS y FROM k),
g AS (SELECT *, CASE WHEN l <= 8 THEN 7.787 * y + 16 / 116 ELSE (l + 16) / 116 END AS fy FROM y), h AS (SELECT *, fy + a / 500 AS fx, fy - b / 200 AS fz FROM g),
z AS (SELECT id, y AS yy, {', '.join(f'CASE WHEN {c} <= 7.787 * 0.008856 + 16 / 116 THEN ({c} - 16 / 116) / 7.787 ELSE pow({c}, 3) END * {w} AS {n}' for c, w, n in (('fx', colour.WHITE[0], 'xx'), ('fz', colour.WHITE[2], 'zz')))} FROM h),
m AS (SELECT id, {', '.join(f'least(greatest({row[0]} * xx + {row[1]} * yy + {row[2]} * zz, 0), 1) AS {n}' for row, n in zip(colour.TO_RGB, 'rgb'))} FROM z)
SELECT id, {', '.join(f'CAST(round_even(255 * CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END, 0) AS INTEGER) AS {c}' for c in 'rgb')} FROM m""")
def rgb_again(spark, d):
    lab = _rgb(spark, d).select("id", colour.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    # A little is added before the cut to 8 bits, which would fall on either side of a whole number.
    back = lab.select("id", colour.lab_to_rgb(F.col("v.l"), F.col("v.a"), F.col("v.b")).alias("w"))
    return back.select("id", *[F.rint(F.col(f"w.{c}") * 255).cast("int").alias(c) for c in "rgb"])


_INFOS = colour.class_infos([0, 3, 5, 7, 11, 12])
_CLASSES = "k(index, code, r, g, b) AS (VALUES " + ", ".join(f"({i['index']}, {i['code']}, {i['rgb'][0]}, {i['rgb'][1]}, {i['rgb'][2]})" for i in _INFOS) + ")"


@query(f"WITH {_CLASSES}, j AS (SELECT l_suppkey % 14 AS raw, k.* FROM lineitem LEFT JOIN k ON l_suppkey % 14 = code) SELECT coalesce(index, -1) AS class_idx, code, [r, g, b] AS rgb, count(*) AS n FROM j WHERE index IS NOT NULL GROUP BY ALL")
def coloured_classes(spark, d):
    px = table(spark, d, "lineitem").select(colour.remap(F.col("l_suppkey") % 14, _INFOS).alias("class_idx")).where("class_idx >= 0")
    return px.groupBy("class_idx", colour.decode(F.col("class_idx"), _INFOS).alias("code"), colour.colorize(F.col("class_idx"), _INFOS).alias("rgb")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CLASSES} SELECT l_suppkey % 14 AS code, count(*) AS n FROM lineitem WHERE l_suppkey % 14 NOT IN (SELECT code FROM k) GROUP BY 1")
def unknown_codes(spark, d):
    return colour.unknown_codes(table(spark, d, "lineitem").select((F.col("l_suppkey") % 14).alias("code")), "code", _INFOS)


@query("""WITH m AS (SELECT l_suppkey % 9 AS code, [l_linenumber, l_partkey % 3, 7] AS rgb, count(*) AS n FROM lineitem GROUP BY ALL) SELECT code, rgb FROM m QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, rgb) = 1""")
def class_colours(spark, d):
    c = F.col
    px = table(spark, d, "lineitem").select((c("l_suppkey") % 9).alias("code"), F.array(c("l_linenumber").cast("bigint"), (c("l_partkey") % 3).cast("bigint"), F.lit(7).cast("bigint")).alias("rgb"))
    return colour.class_colours(px)


@query(f"""WITH {STEPS}, s AS (SELECT cls AS class, step, CASE WHEN cls <> 'error' THEN miou END AS value FROM st) SELECT class, count(*) AS n FROM s WHERE class IN ('click', 'view') GROUP BY class""")
def present_classes(spark, d):
    s = rel.steps(spark, d).select(F.col("cls").alias("class"), "step", F.when(F.col("cls") != "error", F.col("miou")).alias("value"))
    mask = spark.createDataFrame([("click",), ("view",), ("absent",)], "class string")
    return colour.present_classes(s, mask).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


# Masks

_DIMS = GRID + ", dims AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM grid GROUP BY image)"


@query("WITH " + _DIMS + """, t AS (SELECT image, w, h, unnest(range(40)) AS x2 FROM dims), u AS (SELECT *, unnest(range(30)) AS y2 FROM t)
SELECT g.image, gt, count(*) AS n, CAST(sum(x2 * 31 + y2) AS BIGINT) AS places FROM u JOIN grid g ON g.image = u.image AND g.x = CAST(floor((x2 + 0.5) * w / 40) AS BIGINT) AND g.y = CAST(floor((y2 + 0.5) * h / 30) AS BIGINT) GROUP BY ALL""")
def resized_masks(spark, d):
    g = rel.grid(spark, d).select("image", "x", "y", "gt")
    sizes = g.select("image").distinct().withColumns({"w": F.lit(40), "h": F.lit(30)})
    return masks.same_size(g, sizes).groupBy("image", "gt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 31 + F.col("y")).alias("places"))


@query("WITH " + _DIMS + """, p AS (SELECT *, CAST(ceil(w / 48) * 48 AS BIGINT) AS pw, CAST(ceil(h / 48) * 48 AS BIGINT) AS ph FROM dims), t AS (SELECT *, unnest(range(pw)) AS x2 FROM p), u AS (SELECT *, unnest(range(ph)) AS y2 FROM t)
SELECT g.image, count(*) AS n, CAST(sum(gt * (x2 + 3 * y2)) AS BIGINT) AS total FROM u JOIN grid g ON g.image = u.image AND g.x = least(x2, w - 1) AND g.y = least(y2, h - 1) GROUP BY g.image""")
def padded_images(spark, d):
    p = masks.pad(rel.grid(spark, d).select("image", "x", "y", "gt"), 48)
    return p.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gt") * (F.col("x") + 3 * F.col("y"))).alias("total"))


@query("WITH " + _DIMS + """, b AS (SELECT image, list_distinct(list_append(range(0, greatest(w - 24, 0) + 1, 16), greatest(w - 24, 0))) AS sx, list_distinct(list_append(range(0, greatest(h - 24, 0) + 1, 16), greatest(h - 24, 0))) AS sy FROM dims),
t AS (SELECT g.*, list_filter(sx, lambda s: s <= x AND x < s + 24) AS tx, list_filter(sy, lambda s: s <= y AND y < s + 24) AS ty FROM grid g JOIN b USING (image))
SELECT image, CAST(sum(len(tx) * len(ty)) AS BIGINT) AS n, round(sum(list_avg(tx) + gt * list_avg(ty)), 3) AS total FROM t GROUP BY image""")
def tiled_means(spark, d):
    t = masks.tiled(rel.grid(spark, d).select("image", "x", "y", "gt"), 24, 16).withColumn("v", F.col("tx") + F.col("gt") * F.col("ty"))
    means = masks.untiled(t, ["v"], "n").groupBy("image").agg(F.sum("v").alias("total"), F.sum("n").alias("n"))
    return _r(means.select("image", "total", "n"), "total", to=3)


# Distances and components

_DIST = _DIMS + """, m AS (SELECT image, x, y FROM grid WHERE gt > 0), b AS (SELECT image, unnest(range(-1, w + 1)) AS x, h FROM dims), f AS (SELECT image, x, unnest(range(-1, h + 1)) AS y FROM b),
o AS (SELECT f.* FROM f ANTI JOIN m ON m.image = f.image AND m.x = f.x AND m.y = f.y), dt AS (SELECT m.image, m.x, m.y, sqrt(min((m.x - o.x) * (m.x - o.x) + (m.y - o.y) * (m.y - o.y))) AS dist
 FROM m JOIN o ON o.image = m.image AND abs(o.x - m.x) <= 16 AND abs(o.y - m.y) <= 16 GROUP BY ALL)"""


def _distances(spark, d):
    return regions.distance_inside(rel.grid(spark, d).select("image", "x", "y", (F.col("gt") > 0).cast("int").alias("mask")))


@query("WITH " + _DIST + " SELECT image, round(max(dist), 6) AS deepest, round(sum(dist), 4) AS total FROM dt GROUP BY image")
def distance_transform(spark, d):
    return _distances(spark, d).groupBy("image").agg(F.round(F.max("dist"), 6).alias("deepest"), F.round(F.sum("dist"), 4).alias("total"))


@query("WITH " + _DIST + ", t AS (SELECT image, max(dist) AS top FROM dt GROUP BY image) SELECT dt.image, round(sum(dist / top), 4) AS total FROM dt JOIN t USING (image) GROUP BY dt.image")
def normalised_distance(spark, d):
    return _r(regions.normalised_distance(_distances(spark, d)).groupBy("image").agg(F.sum("share").alias("total")), "total", to=4)


@query("WITH " + GRID + " SELECT image, gt, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x) AS INTEGER) AS x1, CAST(max(y) AS INTEGER) AS y1, count(*) AS area FROM grid GROUP BY image, gt")
def component_signatures(spark, d):
    return regions.signatures(rel.grid(spark, d), ("image", "gt"))


@query("WITH " + _DIST.replace("WHERE gt > 0", "WHERE gt = 1") + """ SELECT g.image, count(*) AS n FROM dt JOIN (SELECT *, CAST(CASE WHEN l_quantity / 10 >= greatest(l_discount * 50, l_tax * 60) THEN 0 WHEN l_discount * 50 >= l_tax * 60 THEN 1 ELSE 2 END AS INTEGER) AS pred,
 l_linenumber AS image, rn % 64 AS x, rn // 64 AS y FROM numbered) g ON g.image = dt.image AND g.x = dt.x AND g.y = dt.y WHERE dist > 1 AND pred <> 1 AND (g.x + g.y) % 5 <> 0 GROUP BY g.image""")
def allowed_places(spark, d):
    px = rel.grid(spark, d).withColumn("used", (F.col("x") + F.col("y")) % 5 == 0)
    return regions.allowed(px, 1, 1.0).groupBy("image").agg(F.count(F.lit(1)).alias("n"))


@query()
def raster_components(spark, d):
    """Components by size; against the kernel and brute force in the tests."""
    out = regions.components(rel.grid(spark, d).select("image", "x", "y", F.col("gt").alias("value"))).where("comp > 0")
    return out.groupBy("image").agg(F.count_distinct("comp").alias("n_components"), F.count(F.lit(1)).alias("n"))


@query()
def postprocessed_labels(spark, d):
    """Labels split, merged and numbered; against the fixtures' values in the tests."""
    g = rel.grid(spark, d).select("image", F.floor(F.col("x") / 4).cast("int").alias("x"), F.floor(F.col("y") / 4).cast("int").alias("y"), "gt")
    coarse = g.groupBy("image", "x", "y").agg((F.max("gt") + 1).alias("label"))
    return regions.postprocess(coarse, 12, prune=True).groupBy("image").agg(F.max("label").alias("n_labels"), F.count(F.lit(1)).alias("n"))


@query()
def label_polygons(spark, d):
    """Outlines of the largest part of each class; drawn again in the tests."""
    p = regions.polygons(rel.grid(spark, d).select("image", "x", "y", (F.col("gt") + 1).alias("label")))
    return p.select("image", "label", "area", F.size("holes").alias("n_holes"), F.size("border").alias("n_border"))


# Soft segments

_F = ["f0", "f1"]


def _features(spark, d):
    c = F.col
    return rel.grid_pixels(spark, d).where("x < 24 AND y < 24").select("image", "x", "y", c("sp"), (c("x") / 8).alias("f0"), (c("gt") * 1.0).alias("f1"), (c("y") / 8).alias("f2"), *[(c("gt") == i).cast("double").alias(f"c{i}") for i in range(3)])


_CELL = GRID + """, g0 AS (SELECT image, x, y, sp, x / 8 AS f0, gt * 1.0 AS f1, y / 8 AS f2, gt FROM grid WHERE x < 24 AND y < 24), dm AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM g0 GROUP BY image),
gs AS (SELECT image, w, h, greatest(1, CAST(floor(sqrt(12 * w / h)) AS BIGINT)) AS nx, greatest(1, CAST(floor(sqrt(12 * h / w)) AS BIGINT)) AS ny FROM dm),
ce AS (SELECT g0.*, w, h, nx, ny, x * nx // w AS cx, y * ny // h AS cy FROM g0 JOIN gs USING (image)),
nr AS (SELECT *, unnest(range(9)) AS k FROM ce), ca AS (SELECT *, (cy + k // 3 - 1) * nx + cx + k % 3 - 1 AS seg FROM nr WHERE cx + k % 3 - 1 BETWEEN 0 AND nx - 1 AND cy + k // 3 - 1 BETWEEN 0 AND ny - 1),
m0 AS (SELECT image, cy * nx + cx AS seg, sum(f0) / (count(*) + 1e-6) AS m0, sum(f1) / (count(*) + 1e-6) AS m1 FROM ce GROUP BY 1, 2)"""


def _soft_sql(rounds: int) -> str:
    parts = []
    for i in range(rounds):
        parts.append(f"""d{i} AS (SELECT ca.*, pow(f0 - m0, 2) + pow(f1 - m1, 2) AS d FROM ca JOIN m{i} m USING (image, seg)), e{i} AS (SELECT *, exp(min(d) OVER (PARTITION BY image, x, y) - d) AS e FROM d{i}),
a{i} AS (SELECT * EXCLUDE (e), e / sum(e) OVER (PARTITION BY image, x, y) AS a FROM e{i}), m{i + 1} AS (SELECT image, seg, sum(f0 * a) / (sum(a) + 1e-6) AS m0, sum(f1 * a) / (sum(a) + 1e-6) AS m1 FROM a{i} GROUP BY ALL)""")
    return f"WITH {_CELL}, {', '.join(parts)}"


@query(_soft_sql(3) + " SELECT image, CAST(seg AS INTEGER) AS seg, round(sum(a), 4) AS weight, round(sum(a * d), 4) AS spread FROM a2 GROUP BY ALL")
def soft_segments(spark, d):
    s = soft.assign(_features(spark, d), _F, 12, 3)
    return _r(s.groupBy("image", "seg").agg(F.sum("a").alias("weight"), F.sum(F.col("a") * F.col("d")).alias("spread")), "weight", "spread", to=4)


@query("WITH " + _CELL + """, d0 AS (SELECT image, x, y, k, seg, pow(f0 - m0, 2) + pow(f1 - m1, 2) AS d FROM ca JOIN m0 m USING (image, seg)),
b AS (SELECT image, x, y, seg FROM d0 QUALIFY row_number() OVER (PARTITION BY image, x, y ORDER BY round(d, 9), k) = 1) SELECT image, CAST(seg AS INTEGER) AS seg, count(*) AS n FROM b GROUP BY ALL""")
def hard_segments(spark, d):
    s = soft.assign(_features(spark, d), _F, 12, 1).withColumn("a", -F.round("d", 9))
    return soft.hard_labels(s).groupBy("image", "seg").agg(F.count(F.lit(1)).alias("n"))


_REC = """, r2 AS (SELECT image, x, y, sum(a * m.m0) AS r0, sum(a * m.m1) AS r1, any_value(f0) AS f0, any_value(f1) AS f1 FROM a1 JOIN m2 m USING (image, seg) GROUP BY ALL)"""


@query(_soft_sql(2) + _REC + """, ms AS (SELECT image, avg((pow(r0 - f0, 2) + pow(r1 - f1, 2)) / 2) AS mse FROM r2 GROUP BY image),
lo AS (SELECT image, sum(-greatest(a, 1e-6) * ln(greatest(a, 1e-6))) / count(DISTINCT x * 1000 + y) AS h, count(DISTINCT x * 1000 + y) AS n FROM a1 GROUP BY image), us AS (SELECT image, seg, sum(a) AS a FROM a1 GROUP BY ALL),
gl AS (SELECT us.image, sum(-greatest(us.a / n, 1e-6) * ln(greatest(us.a / n, 1e-6))) AS g FROM us JOIN lo USING (image) GROUP BY us.image),
oh AS (SELECT image, x, y, seg, a, CAST(gt = 0 AS DOUBLE) AS c0, CAST(gt = 1 AS DOUBLE) AS c1, CAST(gt = 2 AS DOUBLE) AS c2, gt FROM a1), om AS (SELECT image, seg, sum(c0 * a) / (sum(a) + 1e-6) AS q0, sum(c1 * a) / (sum(a) + 1e-6) AS q1, sum(c2 * a) / (sum(a) + 1e-6) AS q2 FROM oh GROUP BY ALL),
orr AS (SELECT image, x, y, any_value(gt) AS gt, sum(a * q0) AS r0, sum(a * q1) AS r1, sum(a * q2) AS r2 FROM oh JOIN om USING (image, seg) GROUP BY ALL),
ce2 AS (SELECT image, avg(-ln((CASE gt WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END) / (r0 + r1 + r2 + 1e-6) + 1e-6)) AS ce FROM orr GROUP BY image)
SELECT image, round(mse, 6) AS mse, round(h - 0.2 * g, 6) AS rim, round(ce, 6) AS ce FROM ms JOIN lo USING (image) JOIN gl USING (image) JOIN ce2 USING (image)""")
def soft_losses(spark, d):
    px = _features(spark, d)
    s = soft.assign(px, _F, 12, 2)
    onehot = s.join(px.select("image", "x", "y", "c0", "c1", "c2"), ["image", "x", "y"])
    out = soft.reconstruction_mse(s, _F).join(soft.rim_loss(s), "image").join(soft.reconstruction_entropy(onehot, ["c0", "c1", "c2"]), "image")
    return _r(out, "mse", "rim", "ce")


@query("WITH " + GRID + """, g0 AS (SELECT image, x, y, x / 8 AS f0, gt * 1.0 AS f1, y / 8 AS f2 FROM grid WHERE x < 24 AND y < 24),
h AS (SELECT image, avg(abs(b.f1 - a.f1) * exp(-4 * (abs(b.f0 - a.f0) + abs(b.f2 - a.f2)) / 2)) AS v FROM g0 a JOIN g0 b USING (image) WHERE b.x = a.x + 1 AND b.y = a.y GROUP BY image),
v AS (SELECT image, avg(abs(b.f1 - a.f1) * exp(-4 * (abs(b.f0 - a.f0) + abs(b.f2 - a.f2)) / 2)) AS v FROM g0 a JOIN g0 b USING (image) WHERE b.y = a.y + 1 AND b.x = a.x GROUP BY image)
SELECT image, round(coalesce(h.v, 0) + coalesce(v.v, 0), 6) AS tv FROM h FULL JOIN v USING (image)""")
def total_variation(spark, d):
    return _r(soft.variation(_features(spark, d), "f1", ["f0", "f2"]), "tv")


@query("WITH " + _CELL + """, lg AS (SELECT image, k, -0.75 * (pow(f0 - m0, 2) + pow(f1 - m1, 2)) - 2.5 * (pow((x - (seg % nx + 0.5) * w / nx) / greatest(w / nx, 1.0), 2) + pow((y - (seg // nx + 0.5) * h / ny) / greatest(h / ny, 1.0), 2)) AS l
 FROM ca JOIN m0 m USING (image, seg)) SELECT image, CAST(k AS INTEGER) AS k, count(*) AS n, round(sum(l), 4) AS total FROM lg GROUP BY ALL""")
def local_logits(spark, d):
    out = soft.local_logits(_features(spark, d), _F, 12).groupBy("image", "k")
    return _r(out.agg(F.count(F.lit(1)).alias("n"), F.sum("logit").alias("total")), "total", to=4)


# Layouts and commands

_NAMES = """nm AS (SELECT DISTINCT CASE o_orderkey % 14 WHEN 0 THEN 'docs' WHEN 1 THEN 'results_' || o_custkey WHEN 2 THEN 'm' || o_custkey || '.pth' WHEN 3 THEN 'n' || o_custkey || '.md' WHEN 4 THEN '_tmp_sweep_' || o_custkey WHEN 5 THEN '_refine_x' WHEN 6 THEN '_tmp_novel1'
 WHEN 7 THEN 'out' WHEN 8 THEN 'log' WHEN 9 THEN '_tmp_quarter_a' || o_custkey WHEN 10 THEN '_two_quarters' WHEN 11 THEN 'lib' WHEN 12 THEN 'run.log' ELSE 'thing' || o_custkey END AS name, o_orderkey % 14 NOT IN (2, 3, 12) AS is_dir FROM orders)"""
_WHERE = """CASE WHEN name IN ('lib', 'docs') THEN NULL WHEN name = 'run.log' THEN 'artifacts/debug/run.log' WHEN NOT is_dir THEN CASE WHEN name LIKE '%.pth' THEN 'models/checkpoints/' || name WHEN name LIKE '%.md' THEN 'docs/misc/' || name END WHEN name = 'log' THEN 'artifacts/debug/log'
 WHEN name = 'out' THEN NULL WHEN starts_with(name, 'results_') THEN 'artifacts/interactive_runs/' || name WHEN starts_with(name, '_tmp_sweep_') THEN 'artifacts/sweeps/' || name WHEN starts_with(name, '_refine_') THEN 'artifacts/refinement/' || name
 WHEN starts_with(name, '_tmp_novel') THEN 'artifacts/postprocessing/' || name WHEN name = '_two_quarters' THEN 'artifacts/case_studies/' || name WHEN starts_with(name, '_tmp_quarter_') THEN 'artifacts/debug/' || name ELSE 'artifacts/uncategorized/' || name END"""
_KIND = """CASE WHEN name = 'docs' THEN 'docs' WHEN name = 'run.log' THEN 'artifacts' WHEN NOT is_dir THEN CASE WHEN name LIKE '%.pth' THEN 'models' WHEN name LIKE '%.md' THEN 'docs' ELSE 'core' END
 WHEN name IN ('out', 'log', '_two_quarters') OR starts_with(name, 'results_') OR starts_with(name, '_tmp_') OR starts_with(name, '_refine_') THEN 'artifacts' WHEN name = 'lib' THEN 'core' ELSE 'uncategorized' END"""
_CORE, _EXPLICIT = ("lib", "docs"), {"run.log": "artifacts/debug/run.log"}


def _names(spark, d):
    c, k, cust = F.col, F.col("o_orderkey") % 14, F.col("o_custkey").cast("string")
    made = {0: F.lit("docs"), 1: F.concat(F.lit("results_"), cust), 2: F.concat(F.lit("m"), cust, F.lit(".pth")), 3: F.concat(F.lit("n"), cust, F.lit(".md")), 4: F.concat(F.lit("_tmp_sweep_"), cust), 5: F.lit("_refine_x"), 6: F.lit("_tmp_novel1"),
            7: F.lit("out"), 8: F.lit("log"), 9: F.concat(F.lit("_tmp_quarter_a"), cust), 10: F.lit("_two_quarters"), 11: F.lit("lib"), 12: F.lit("run.log")}
    name = F.concat(F.lit("thing"), cust)
    for i, v in made.items():
        name = F.when(k == i, v).otherwise(name)
    return table(spark, d, "orders").select(name.alias("name"), (~k.isin(2, 3, 12)).alias("is_dir"), F.lit(None).cast("string").alias("parent")).distinct()


@query(f"WITH {_NAMES} SELECT name, {_KIND} AS kind, {_WHERE} AS target FROM nm")
def top_level_layout(spark, d):
    n, dir_ = F.col("name"), F.col("is_dir")
    return _names(spark, d).select("name", layout.top_level_kind(n, dir_, _CORE, _EXPLICIT).alias("kind"), layout.top_level_target(n, dir_, _CORE, _EXPLICIT).alias("target"))


@query(f"""WITH {_NAMES}, sp AS (SELECT name AS source, {_WHERE} AS target, 'top-level:' || {_KIND} AS reason FROM nm), al AS (SELECT * FROM sp WHERE target IS NOT NULL
 UNION ALL SELECT 'out/' || n_name, 'artifacts/case_studies/' || n_name, 'out-case-study' FROM nation UNION ALL SELECT 'out/vis_compare_1', 'artifacts/postprocessing/vis_compare_1', 'out-postprocessing')
SELECT source, target, CASE WHEN length(source) % 3 = 0 THEN 'missing' WHEN length(target) % 4 = 0 THEN 'exists' ELSE 'moved' END AS status FROM al""")
def move_outcomes(spark, d):
    inside = table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("vis_compare_1",)], "name string")).select("name", F.lit(True).alias("is_dir"), F.lit("out").alias("parent"))
    specs = layout.move_specs(_names(spark, d).unionByName(inside), _CORE, _EXPLICIT)
    have = specs.where("length(source) % 3 <> 0").select(F.col("source").alias("path")).unionByName(specs.where("length(target) % 4 = 0").select(F.col("target").alias("path")))
    return layout.move_outcomes(specs, have)


@query("""WITH p AS (SELECT DISTINCT regexp_replace(path, '/+', '/', 'g') AS p FROM state_files WHERE path IS NOT NULL)
SELECT CASE WHEN starts_with(p, '/data/') THEN substr(p, 7) END AS rel, sha256(p) AS hash, regexp_extract(p, '([^/]*)$', 1) IN ('summary.csv', 'summary.json', 'comparison_summary.json', 'batch_summary.csv') AS summary FROM p""")
def path_facts(spark, d):
    p = table(spark, d, "state_files").select(F.regexp_replace("path", "/+", "/").alias("p")).where("p IS NOT NULL").distinct()
    return p.select(layout.relative(F.col("p"), "/data").alias("rel"), layout.sha256(F.col("p")).alias("hash"), layout.is_summary(F.regexp_extract("p", "([^/]*)$", 1)).alias("summary"))


@query("""SELECT DISTINCT run_dir, run_dir || '/interactive_annotation_replay.mp4' AS own, '/v/' || regexp_extract(run_dir, '([^/]*)/*$', 1) || '.mp4' AS below FROM sweep_cases WHERE run_dir IS NOT NULL""")
def video_targets(spark, d):
    r = table(spark, d, "sweep_cases").select("run_dir").where("run_dir IS NOT NULL").distinct()
    return r.select("run_dir", layout.video_target(F.col("run_dir")).alias("own"), layout.video_target(F.col("run_dir"), "/v").alias("below"))


@query("""WITH p AS (SELECT DISTINCT case_id, params FROM sweep_cases WHERE params IS NOT NULL), k AS (SELECT case_id, params, unnest(map_keys(params)) AS k, unnest(map_values(params)) AS v FROM p)
SELECT DISTINCT case_id, 'eval --' || string_agg(k || ' ' || v, ' --' ORDER BY k) || ' --no_overlap' AS line FROM k WHERE v IS NOT NULL GROUP BY case_id, params""")
def command_lines(spark, d):
    c = table(spark, d, "sweep_cases").where("params IS NOT NULL AND size(params) > 0")
    return c.select("case_id", F.array_join(layout.command(["eval"], F.col("params"), F.array(F.lit("no_overlap"))), " ").alias("line")).distinct()


@query("""WITH f AS (SELECT '/r/' || o_custkey AS d, CASE o_orderkey % 3 WHEN 0 THEN 'interactive_log.json' WHEN 1 THEN 'summary_metrics.json' ELSE 'x.csv' END AS n FROM orders)
SELECT d AS run_dir FROM f GROUP BY d HAVING bool_or(n = 'interactive_log.json') AND bool_or(n = 'summary_metrics.json')""")
def finished_run_dirs(spark, d):
    k = F.col("o_orderkey") % 3
    n = F.when(k == 0, "interactive_log.json").when(k == 1, "summary_metrics.json").otherwise("x.csv")
    return logs.finished(table(spark, d, "orders").select(F.concat(F.lit("/r/"), F.col("o_custkey").cast("string"), F.lit("/"), n).alias("path")))


@query("""WITH l AS (SELECT user_id AS host, event_id % 5 AS pid, CAST(floor(value) AS INTEGER) AS mib FROM events WHERE event_id % 7 <> 0) SELECT CAST(host AS VARCHAR) AS host, CAST(pid AS INTEGER) AS pid, CAST(sum(mib) AS BIGINT) AS mib FROM l GROUP BY ALL""")
def gpu_memory(spark, d):
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("pid, [N/A]")).otherwise(F.concat(F.lit(" "), (F.col("event_id") % 5).cast("string"), F.lit(", "), F.floor("value").cast("string")))
    return logs.gpu_memory(e.groupBy(F.col("user_id").cast("string").alias("host")).agg(F.array_join(F.collect_list(line), "\n").alias("text")))


@query("SELECT c_nationkey AS pid, c_custkey AS child FROM customer WHERE c_custkey % 4 <> 0")
def child_pids(spark, d):
    c = table(spark, d, "customer")
    word = F.when(F.col("c_custkey") % 4 == 0, F.lit("x")).otherwise(F.col("c_custkey").cast("string"))
    return logs.child_pids(c.groupBy(F.col("c_nationkey").alias("pid")).agg(F.array_join(F.collect_list(word), " ").alias("children")))


@query()
def suggested_trials(spark, d):
    """Drawn trials; bounds and steps in the tests."""
    return bench.suggest(spark, {"scale": (20.0, 4000.0, "log"), "sigma": (0.0, 3.0), "min_size": (5, 500, 5), "fdim": [20, 30]}, 200)


# Prompts

_LINE = "ln AS (SELECT user_id AS id, list({'x': value, 'y': CAST(event_id AS DOUBLE)} ORDER BY event_id) AS p FROM events WHERE event_id % 37 = 0 GROUP BY user_id)"


def _lines(spark, d):
    e = table(spark, d, "events").where("event_id % 37 = 0").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    return e.select("id", F.transform("l", lambda x: F.struct(x["value"].alias("x"), x["event_id"].cast("double").alias("y"))).alias("p"))


@query(f"WITH {_LINE} SELECT id, [p[len(p) // 2 + 1].x] AS point, CASE WHEN len(p) >= 2 THEN [p[1].x, p[-1].x] ELSE [p[1].x] END AS line, len(p) AS n FROM ln")
def prompt_points(spark, d):
    xs = lambda kind: F.transform(prompts.prompt_points(F.lit(kind), F.col("p")), lambda q: q["x"])
    return _lines(spark, d).select("id", xs("Point").alias("point"), xs("line").alias("line"), F.size(xs("mark")).cast("bigint").alias("n"))


@query(f"""WITH {_LINE}, lg AS (SELECT id, list_transform(range(1, len(p)), lambda i: sqrt(pow(p[i].x - p[i + 1].x, 2) + pow(p[i].y - p[i + 1].y, 2))) AS l, len(p) // 2 AS c FROM ln),
s AS (SELECT id, coalesce(list_sum(l[:c]), 0) AS a, coalesce(list_sum(l[c + 1:]), 0) AS b FROM lg) SELECT id, round(CASE WHEN greatest(a, b) > 1e-6 THEN least(a, b) / greatest(a, b) ELSE 0 END, 6) AS balance FROM s""")
def arm_balance(spark, d):
    return _r(_lines(spark, d).select("id", prompts.arm_balance(F.col("p"), F.floor(F.size("p") / 2)).alias("balance")), "balance")


@query("""WITH s AS (SELECT event_id AS id, user_id AS direct, user_id % 7 AS u, value / 100 AS core, value / 200 AS comp, event_id % 10 / 10 AS cs, event_id % 3 / 3 AS ms, value / 500 AS ln FROM events)
SELECT id, round(direct / greatest(1, u), 6) AS direct_gain, round(4 * direct / greatest(1, u) + 0.9 * core + 0.55 * comp + 0.6 * cs + 0.3 * ms + 0.35 * ln, 8) AS score FROM s""")
def scribble_scores(spark, d):
    c = F.col
    e = table(spark, d, "events").select(c("event_id").alias("id"), c("user_id").alias("direct"), (c("user_id") % 7).alias("union"), (c("value") / 100).alias("core_covered"), (c("value") / 200).alias("component_covered"),
                                         (c("event_id") % 10 / 10).alias("center_support"), (c("event_id") % 3 / 3).alias("min_support"), (c("value") / 500).alias("length"))
    return _r(_r(prompts.scribble_score(e).select("id", "direct_gain", "score"), "direct_gain"), "score", to=8)


@query("""WITH s AS (SELECT event_id AS id, event_id % 3 * 1.5 AS sens, value / 200 AS iou, user_id % 6 AS n, user_id % 15 AS total, 3 AS classes FROM events), k AS (SELECT *, total >= 6 AS late, (total >= 6 AND (n >= 3 OR iou >= 0.45)) OR (n >= 4 AND iou >= 0.6) AS bold FROM s)
SELECT id, CASE WHEN sens <= 0 THEN 0 WHEN bold THEN 2 ELSE 1 END AS n, CASE WHEN sens > 0 THEN CAST(round(sens * 0.45, 6) AS DOUBLE) END AS careful, CASE WHEN sens > 0 AND bold THEN CAST(round(sens * CASE WHEN late THEN 0.7 ELSE 0.6 END, 6) AS DOUBLE) END AS bold FROM k""")
def propagation_profiles(spark, d):
    c = F.col
    e = table(spark, d, "events").select(c("event_id").alias("id"), prompts.propagation_profiles(c("event_id") % 3 * 1.5, c("value") / 200, c("user_id") % 6, c("user_id") % 15, F.lit(3), False).alias("p"))
    at = lambda i: F.when(F.size("p") > i, F.round(F.col("p")[i]["sens"], 6))
    return e.select("id", F.size("p").alias("n"), at(0).alias("careful"), at(1).alias("bold"))


@query("""WITH l AS (SELECT p_partkey AS id, p_size % 3 AS colour, p_size / 50.0 AS x0, p_partkey % 17 / 17.0 AS y0, p_partkey % 13 / 13.0 AS x1, p_size % 11 / 11.0 AS y1 FROM part WHERE p_partkey < 400),
c AS (SELECT a.id AS new_id, b.id AS old_id, sign((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) AS s1, sign((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) AS s2,
 sign((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) AS s3, sign((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) AS s4 FROM l a JOIN l b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.colour <> b.colour)
SELECT new_id, old_id FROM c WHERE s1 * s2 < 0 AND s3 * s4 < 0""")
def line_crossings(spark, d):
    c = F.col
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    p = table(spark, d, "part").where("p_partkey < 400").select(
        F.lit(1).alias("image"), c("p_partkey").alias("id"), (c("p_size") % 3).alias("colour"), F.array(pt(c("p_size") / 50.0, c("p_partkey") % 17 / 17.0), pt(c("p_partkey") % 13 / 13.0, c("p_size") % 11 / 11.0)).alias("points"))
    met = prompts.crossings(p.where("id % 2 = 0"), p.where("id % 2 = 1"))
    # Lines that only touch can fall on either side in another engine: only real crossings are compared.
    ends = p.select("id", c("points")[0].alias("a"), c("points")[1].alias("b"))
    both = met.join(ends.select(c("id").alias("new_id"), c("a").alias("na"), c("b").alias("nb")), "new_id").join(ends.select(c("id").alias("old_id"), c("a").alias("oa"), c("b").alias("ob")), "old_id")
    side = lambda u, v, w: F.signum((c(v)["x"] - c(u)["x"]) * (c(w)["y"] - c(u)["y"]) - (c(v)["y"] - c(u)["y"]) * (c(w)["x"] - c(u)["x"]))
    return both.where((side("na", "nb", "oa") * side("na", "nb", "ob") < 0) & (side("oa", "ob", "na") * side("oa", "ob", "nb") < 0)).select("new_id", "old_id")


@query("""WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN value / 512 + 0.0001 END AS m, CASE WHEN event_id % 5 > 0 THEN event_id % 100 / 100 END AS c, user_id AS px FROM events)
SELECT id, coalesce(printf('mIoU %.3f', m) || ' | ', '') || coalesce(printf('coverage %.3f', c) || ' | ', '') || 'annotated_px ' || px || ' | New annotations pulse in their class color' AS line FROM s""")
def step_footers(spark, d):
    c = F.col
    e = table(spark, d, "events").select(c("event_id").alias("id"), F.when(c("event_id") % 3 > 0, c("value") / 512 + 0.0001).alias("m"), F.when(c("event_id") % 5 > 0, c("event_id") % 100 / 100).alias("c"), c("user_id").alias("px"))
    return e.select("id", prompts.metrics_footer(c("m"), c("c"), F.lit(None).cast("double"), c("px"), F.lit(False)).alias("line"))


# States and events

@query(f"""WITH {STEPS}, an AS (SELECT run, step // 10 AS idx, ascii(cls) AS sp, max(step) % 3 AS code, max(step) % 2 = 0 AS direct FROM st WHERE step % 10 <> 7 GROUP BY ALL), sc AS (SELECT DISTINCT run, step // 10 AS idx, step % 23 AS sid FROM st),
ix AS (SELECT run, idx, row_number() OVER (PARTITION BY run ORDER BY idx) AS nth FROM (SELECT DISTINCT run, step // 10 AS idx FROM st)), cu AS (SELECT run, nth, count(*) AS cur FROM sc JOIN ix USING (run, idx) GROUP BY ALL),
a2 AS (SELECT run, nth, sp, code, direct FROM an JOIN ix USING (run, idx)), ch AS (SELECT a.* FROM a2 a LEFT JOIN a2 b ON b.run = a.run AND b.sp = a.sp AND b.nth = a.nth - 1 WHERE b.sp IS NULL OR b.code <> a.code OR b.direct <> a.direct),
s2 AS (SELECT run, nth, sid FROM sc JOIN ix USING (run, idx)), nw AS (SELECT a.* FROM s2 a LEFT JOIN s2 b ON b.run = a.run AND b.sid = a.sid AND b.nth = a.nth - 1 WHERE b.sid IS NULL)
SELECT ix.run, CAST(ix.idx AS INTEGER) AS index, coalesce(p.cur, 0) AS prev_step, c.cur AS cur_step, greatest(c.cur - coalesce(p.cur, 0), 0) AS step_delta, c.cur - coalesce(p.cur, 0) = 1 AS exact,
 (SELECT coalesce(list(CAST(sid AS INTEGER) ORDER BY sid), []) FROM nw WHERE nw.run = ix.run AND nw.nth = ix.nth) AS new_scribbles, (SELECT coalesce(list(sp ORDER BY sp), []) FROM ch WHERE ch.run = ix.run AND ch.nth = ix.nth AND direct) AS direct_sps,
 (SELECT coalesce(list(sp ORDER BY sp), []) FROM ch WHERE ch.run = ix.run AND ch.nth = ix.nth AND NOT direct) AS propagated_sps FROM ix JOIN cu c ON c.run = ix.run AND c.nth = ix.nth LEFT JOIN cu p ON p.run = ix.run AND p.nth = ix.nth - 1""")
def annotation_events(spark, d):
    st = rel.steps(spark, d).withColumn("index", F.floor(F.col("step") / 10).cast("int"))
    an = st.where("step % 10 <> 7").groupBy("run", "index", F.ascii("cls").alias("sp")).agg((F.max("step") % 3).alias("code"), (F.max("step") % 2 == 0).alias("direct")).withColumn("parents", F.array(F.lit(1)))
    return events.build_events(st.select("run", "index"), st.select("run", "index", (F.col("step") % 23).alias("sid")), an)


_TEXT = """t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{"superpixels":{"slic_b":[],"slic_a":[]}}' WHEN 1 THEN '{"_meta":{"version":3,"methods":["x","slic_c"]},"superpixels":{"slic_b":[],"slic_c":[]}}'
 WHEN 2 THEN '{"annotations":{"z":[]},"superpixels":{}}' WHEN 3 THEN '{"scribbles":[]}' ELSE '{ }' END AS s FROM part)"""


def _texts(spark, d):
    k = F.col("p_partkey") % 5
    s = (
        F.when(k == 0, '{"superpixels":{"slic_b":[],"slic_a":[]}}').when(k == 1, '{"_meta":{"version":3,"methods":["x","slic_c"]},"superpixels":{"slic_b":[],"slic_c":[]}}')
        .when(k == 2, '{"annotations":{"z":[]},"superpixels":{}}').when(k == 3, '{"scribbles":[]}').otherwise("{ }")
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s"))


@query(f"""WITH {_TEXT} SELECT id, CASE id % 5 WHEN 0 THEN 'slic_a' WHEN 1 THEN 'slic_c' WHEN 2 THEN 'z' END AS method, CASE WHEN id % 5 = 1 THEN 3 ELSE 1 END AS version, CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS n_methods FROM t""")
def migrated_states(spark, d):
    m = _texts(spark, d).withColumn("m", states.migrated(F.col("s")))
    return m.select("id", states.chosen_method(F.col("m")).alias("method"), F.get_json_object("m", "$._meta.version").cast("int").alias("version"), F.json_array_length(F.get_json_object("m", "$._meta.methods")).alias("n_methods"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{"n":' || o_custkey || ',"deep":true}' WHEN 1 THEN '[1]' WHEN 2 THEN ' ' ELSE '{"n":' END AS s FROM orders)
SELECT id, CASE WHEN id % 4 = 0 THEN CAST(json_extract_string(s, '$.n') AS INTEGER) END AS n, CASE id % 4 WHEN 1 THEN 'no object' WHEN 3 THEN 'no JSON' END AS problem FROM t""")
def parsed_configs(spark, d):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.concat(F.lit('{"n":'), F.col("o_custkey").cast("string"), F.lit(',"deep":true}'))).when(k == 1, "[1]").when(k == 2, " ").otherwise('{"n":')
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), states.parsed_config(s).alias("c"))
    return t.select("id", F.element_at("c.config", "n").cast("int").alias("n"), "c.problem")


@query("""SELECT o_orderkey AS id, m.method, m.config, m.problem FROM orders, (VALUES ('slic', '{"a":1}', NULL), ('ssn', '{"b":2}', NULL), ('ssn', NULL, 'no object'), ('sin', NULL, 'empty')) m(method, config, problem) WHERE o_orderkey % 50 = 0""")
def method_configs(spark, d):
    text = '{" SLIC ":{"a":1},"ssn":[{"b":2},7],"sin":[]}'
    t = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("id"), states.method_configs(F.lit(text)).alias("m"))
    return t.select("id", F.inline("m"))


@query("""WITH r AS (SELECT DISTINCT record_id, methods FROM finished_runs WHERE methods IS NOT NULL), e AS (SELECT record_id, unnest(methods) AS m, unnest(range(len(methods))) AS i FROM r), v AS (SELECT record_id, m.method AS k, CASE WHEN NOT isnan(m.miou_mean) THEN m.miou_mean END AS s FROM e WHERE m.method IS NOT NULL),
o AS (SELECT record_id, k, max(s) AS s FROM v GROUP BY ALL) SELECT record_id, count(*) AS method_count, round(max(s), 6) AS best_miou FROM o GROUP BY record_id""")
def json_summaries(spark, d):
    r = table(spark, d, "finished_runs").where("methods IS NOT NULL").select("record_id", "methods").distinct().select("record_id", F.inline("methods")).where("method IS NOT NULL")
    each = r.groupBy("record_id", "method").agg(F.max(F.when(~F.isnan("miou_mean"), F.col("miou_mean"))).alias("miou")).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("miou")))).alias("methods"))
    out = each.select("record_id", states.json_summary(F.to_json(F.struct("methods"))).alias("s"))
    return _r(out.select("record_id", F.col("s.method_count").cast("bigint").alias("method_count"), "s.best_miou"), "best_miou")


@query(f"""WITH {_OPEN} SELECT DISTINCT record_id, coalesce(json_extract_string(s, '$._meta.magic'), 'spanno') AS magic, coalesce(TRY_CAST(json_extract_string(s, '$._meta.version') AS INTEGER), 1) AS version,
 TRY_CAST(json_extract_string(s, '$._meta.image.size_wh[0]') AS INTEGER) AS width, TRY_CAST(json_extract_string(s, '$._meta.image.size_wh[1]') AS INTEGER) AS height FROM states""")
def state_headers(spark, d):
    return states.states(table(spark, d, "state_docs")).drop("state").distinct()


@query(f"""WITH {_OPEN}, newest AS (SELECT record_id, arg_max(doc_json, {{'t': received_at, 'd': doc_json}}) AS doc FROM state_docs GROUP BY record_id), kept AS (SELECT i.record_id, i.t, i.k, i.e FROM items i),
one AS (SELECT record_id FROM state_docs GROUP BY record_id HAVING count(DISTINCT coalesce(doc_json, '-')) = 1)
SELECT record_id, CASE t WHEN 'sp' THEN 'superpixels' ELSE 'annotations' END AS part, k AS method, count(*) AS n FROM kept WHERE record_id IN (SELECT record_id FROM one) AND k IS NOT NULL AND json_type(e) = 'OBJECT' GROUP BY ALL""")
def state_roundtrip(spark, d):
    """States taken apart to the items' whole texts, put together again, and taken apart once more: the items by record, part and method."""
    docs = table(spark, d, "state_docs")
    one = docs.groupBy("record_id").agg(F.count_distinct(F.coalesce("doc_json", F.lit("-"))).alias("n")).where("n = 1")
    first = states.states(states.latest(docs).join(one, "record_id", "left_semi"))
    again = states.states(states.documents(states.full_items(first), first.select("record_id", "width", "height")))
    items = states.full_items(again).where("part <> 'scribbles' AND method IS NOT NULL AND ltrim(item) LIKE '{%'")
    return items.groupBy("record_id", "part", "method").agg(F.count(F.lit(1)).alias("n"))


# Small reports

_CM = _CLS + """, a AS (SELECT image, sum(CASE WHEN gt = pred THEN n ELSE 0 END) / sum(n) AS acc FROM cm GROUP BY ALL), im AS (SELECT image, acc, avg(tp / (tp + fp + fn)) AS miou FROM cl JOIN a USING (image) GROUP BY image, acc)"""


@query("WITH " + _CELL + """, lg AS (SELECT image, x, y, seg, -0.75 * (pow(f0 - m0, 2) + pow(f1 - m1, 2)) - 2.5 * (pow((x - (seg % nx + 0.5) * w / nx) / greatest(w / nx, 1.0), 2) + pow((y - (seg // nx + 0.5) * h / ny) / greatest(h / ny, 1.0), 2)) AS l
 FROM ca JOIN m0 m USING (image, seg)), e AS (SELECT image, x, y, seg, exp(l - max(l) OVER (PARTITION BY image, x, y)) AS e FROM lg), a AS (SELECT image, seg, e / sum(e) OVER (PARTITION BY image, x, y) AS a FROM e) SELECT image, CAST(seg AS INTEGER) AS seg, round(sum(a), 4) AS weight FROM a GROUP BY ALL""")
def local_assignment(spark, d):
    a = soft.assignment(soft.local_logits(_features(spark, d), _F, 12))
    return _r(a.groupBy("image", "seg").agg(F.sum("a").alias("weight")), "weight", to=4)


@query("WITH " + GRID + """, p AS (SELECT image, gt, x, y, (x * 7 + y * 3) % 11 + 1.0 AS dist FROM grid WHERE sp % 5 = 0), q AS (SELECT image, gt, quantile_cont(dist, 0.8) AS cut FROM p GROUP BY ALL), k AS (SELECT p.* FROM p JOIN q USING (image, gt) WHERE dist >= cut),
m AS (SELECT image, gt, count(*) AS n, sum(dist) AS w, sum(dist * x) / sum(dist) AS mx, sum(dist * y) / sum(dist) AS my FROM k GROUP BY ALL), v AS (SELECT k.image, k.gt, sum(dist * (x - mx) * (x - mx)) AS a, sum(dist * (y - my) * (y - my)) AS d, sum(dist * (x - mx) * (y - my)) AS b FROM k JOIN m USING (image, gt) WHERE n >= 2 GROUP BY ALL)
SELECT image, gt, round(abs(cos(atan2(2 * b, a - d) / 2)), 4) AS dx, round(abs(sin(atan2(2 * b, a - d) / 2)), 4) AS dy FROM v""")
def principal_directions(spark, d):
    g = rel.grid(spark, d).where("sp % 5 = 0").select("image", "gt", "x", "y", ((F.col("x") * 7 + F.col("y") * 3) % 11 + 1.0).alias("dist"))
    out = raster.principal_direction(g, ("image", "gt"))
    return _r(out.select("image", "gt", F.abs("dx").alias("dx"), F.abs("dy").alias("dy")), "dx", "dy", to=4)


@query("""WITH s AS (SELECT 'S' || (n_regionkey % 3 + 1) AS s, n_nationkey % 9 AS code, n_name AS name FROM nation WHERE n_regionkey < 4) SELECT code, arg_max(name, {'s': s, 'n': name}) AS name FROM s WHERE s IN ('S1', 'S2') GROUP BY code""")
def merged_classes(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 4").select(F.concat(F.lit("S"), (F.col("n_regionkey") % 3 + 1).cast("string")).alias("set"), (F.col("n_nationkey") % 9).alias("code"), F.col("n_name").alias("name"))
    return colour.merged_classes(n, ["S1", "S2"])


@query("""WITH f AS (SELECT '/r/' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'app/' ELSE 'app/deep/' END || p_brand || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.sh' ELSE '.md' END AS p FROM part)
SELECT DISTINCT substr(p, 4) AS script FROM f WHERE regexp_matches(p, '^/r/[^/]+\\.(py|sh)$') OR regexp_matches(p, '^/r/app/[^/]+\\.py$')""")
def script_files(spark, d):
    c = F.col
    folder = F.when(c("p_size") % 3 == 0, "").when(c("p_size") % 3 == 1, "app/").otherwise("app/deep/")
    end = F.when(c("p_partkey") % 3 == 0, ".py").when(c("p_partkey") % 3 == 1, ".sh").otherwise(".md")
    return layout.scripts(table(spark, d, "part").select(F.concat(F.lit("/r/"), folder, "p_brand", end).alias("path")), "/r", ("app",))


@query("""WITH t AS (SELECT user_id AS run, count(*) AS n, sum(event_id) AS total FROM events GROUP BY 1) SELECT run, CAST(CASE WHEN run % 4 = 0 THEN 0 ELSE total END AS DOUBLE) AS ms FROM t""")
def profile_totals(spark, d):
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.sum("event_id").alias("total"))
    text = F.when(F.col("run") % 4 == 0, F.lit("forward 3 ms\nTOTAL none")).otherwise(F.concat(F.lit("stage 5.0 ms\n  TOTAL 1.0 ms\n  TOTAL time:   "), F.col("total").cast("string"), F.lit(" ms\nend")))
    return t.select("run", logs.total_ms(text).alias("ms"))


@query("""SELECT p_partkey AS id, 'POLYGON ((' || p_size || ' 0, ' || p_size || ' 2, 0 2, ' || p_size || ' 0)' || CASE WHEN p_partkey % 2 = 0 THEN ', (1 1, 2 1, 1 2, 1 1)' ELSE '' END || ')' AS wkt, 'LINESTRING (' || p_size || ' 0, 1 1)' AS line FROM part""")
def well_known_texts(spark, d):
    pt = lambda x, y: F.struct(x.cast("int").alias("x"), F.lit(y).alias("y"))
    one, two, size = F.lit(1), F.lit(2), F.col("p_size")
    hole = F.array(pt(one, 1), pt(two, 1), pt(one, 2))
    holes = F.when(F.col("p_partkey") % 2 == 0, F.array(hole))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), geometry.wkt_polygon(F.array(pt(size, 0), pt(size, 2), pt(F.lit(0), 2)), holes).alias("wkt"), geometry.wkt_line(F.array(pt(size, 0), pt(one, 1))).alias("line"))


@query("WITH " + _CM + """ SELECT count(DISTINCT image) AS n_images, round(avg(acc), 6) AS accuracy, round(avg(miou), 6) AS miou FROM im""")
def mean_over_images(spark, d):
    per = quality.summary(quality.confusion(rel.pixels(spark, d).where("valid"), by=("image",)), ("image",))
    return _r(quality.mean_over_images(per, ["accuracy", "miou"]), "accuracy", "miou")


def _slope_sql(c: str, axis: str) -> str:
    w = f"OVER (PARTITION BY image, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"
    return f"CASE WHEN lag({c}) {w} IS NULL AND lead({c}) {w} IS NULL THEN 0 WHEN lag({c}) {w} IS NULL THEN lead({c}) {w} - {c} WHEN lead({c}) {w} IS NULL THEN {c} - lag({c}) {w} ELSE (lead({c}) {w} - lag({c}) {w}) / 2 END"


@query("WITH " + GRID + f""", p AS (SELECT image, x, y, sp % 101 / 100 AS h0, gt * 40 / 128 AS h1, (sp % 7 - 3) * 20 / 128 AS h2 FROM grid),
s AS (SELECT *, {_slope_sql('h0', 'x')} AS h3, {_slope_sql('h0', 'y')} AS h4, {_slope_sql('h1', 'y')} AS da, {_slope_sql('h2', 'x')} AS db FROM p), d AS (SELECT image, max(x) AS mx, max(y) AS my FROM p GROUP BY image)
SELECT image, round(sum(h3 * h3), 7) AS across, round(sum(h4 * h4), 7) AS down, round(sum(sqrt(da * da + db * db)), 7) AS colour, round(avg(x / mx), 6) AS x, round(avg(y / my), 6) AS y FROM s JOIN d USING (image) GROUP BY image""")
def handcrafted_features(spark, d):
    c = F.col
    px = rel.grid(spark, d).select("image", "x", "y", (c("sp") % 101).alias("l"), (c("gt") * 40).alias("a"), ((c("sp") % 7 - 3) * 20).alias("b"))
    h = soft.handcrafted(px).select("image", *soft.fitted([f"h{i}" for i in range(8)], 8)).groupBy("image")
    out = h.agg(F.sum(c("f3") ** 2).alias("across"), F.sum(c("f4") ** 2).alias("down"), F.sum("f5").alias("colour"), F.avg("f6").alias("x"), F.avg("f7").alias("y"))
    return _r(_r(out, "across", "down", "colour", to=7), "x", "y")


@query("WITH " + _DIMS + """, p AS (SELECT image, x + 0.25 AS px, y + 0.5 AS py FROM grid WHERE sp % 40 = 0) SELECT g.image, count(*) AS n, CAST(sum(g.x + 3 * g.y) AS BIGINT) AS places FROM (SELECT d.image, xs.x, ys.y FROM dims d, LATERAL (SELECT unnest(range(d.w)) AS x) xs, LATERAL (SELECT unnest(range(d.h)) AS y) ys) g
 WHERE EXISTS (SELECT 1 FROM p WHERE p.image = g.image AND (g.x - px) * (g.x - px) + (g.y - py) * (g.y - py) <= 9) GROUP BY g.image""")
def stamped_discs(spark, d):
    g = rel.grid(spark, d)
    pts = g.where("sp % 40 = 0").select("image", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"))
    return raster.discs(pts, masks.dimensions(g), 3).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") + 3 * F.col("y")).alias("places"))
