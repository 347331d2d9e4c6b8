import math
import random
import re
import time

from tests.conftest import rows
from tessela import storage
from tessela.operators import bench, events, graph, quality, spatial, votes
from tessela.functions import geometry, text
from pyspark.sql import functions as F


def test_box_join_equals_brute_force(spark):
    rnd = random.Random(1)
    boxes = []
    for i in range(120):
        x, y = rnd.uniform(-2, 2), rnd.uniform(-2, 2)
        boxes.append((i, x, x + rnd.uniform(0, 0.5), y, y + rnd.uniform(0, 0.5)))
    df = spark.createDataFrame([*boxes, (999, None, 1.0, 0.0, 1.0)], "id int, x0 double, x1 double, y0 double, y1 double")
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[2] and a[2] >= b[1] and a[3] <= b[4] and a[4] >= b[3]}
    assert rows(spatial.box_join(df, df, 0.3)) == want


def test_equal_boxes_are_compared_as_one(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TOGETHER", 4)
    boxes = [(i, i % 3 * 1.0, i % 3 + 1.0 - i % 2 / 4, 0.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(boxes, "id int, x0 double, x1 double, y0 double, y1 double")
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[2] and a[2] >= b[1]}
    assert rows(spatial.box_join(df, df, 0.3, ordered=True)) == want


def test_radius_join_equals_brute_force(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    want = {(a[0], b[0]) for a in pts for b in pts if math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.2}
    assert rows(spatial.radius_join(df, df, 0.2), "a_id", "b_id") == want


def test_asof_falls_back_to_first(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.1), (1, 3, 0.4), (2, 7, 0.7)], "run int, step int, miou double")
    got = rows(spatial.asof_budgets(df, [1, 2, 3]))
    assert got == {(1, 1, 1, 0.1), (1, 2, 1, 0.1), (1, 3, 3, 0.4), (2, 1, 7, 0.7), (2, 2, 7, 0.7), (2, 3, 7, 0.7)}


def test_low_confidence_vote(spark):
    logits = [(0, 5.0, 0.1), (0, 0.3, 0.4), (1, 0.2, 4.0), (1, 4.0, 0.1)]
    df = spark.createDataFrame([(1, sp, 0, a, b, -50.0, True, 0 if a > b else 1) for sp, a, b in logits], "image int, sp int, gt int, lg0 double, lg1 double, lg2 double, valid boolean, pred int")
    got = votes.vote(df, threshold=0.6).orderBy("sp", F.desc("lg0")).select("label").collect()
    assert [r.label for r in got] == [0, 0, 0, 1]
    guarded = votes.vote(df, threshold=0.6, guards={"max_changed": 0.25})
    assert all(r.label == r.pred for r in guarded.collect())


def test_case_labels(spark):
    s = lambda c: spark.range(1).select(c.alias("v")).first().v
    m = lambda **kv: F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k, v)])
    slic = m(n_segments="12", compactness="3.5", sigma="0.0")
    assert s(text.case_label(F.lit("slic"), slic)) == s(text.study_label(F.lit("slic"), slic)) == "slic__compactness_3p5__n_segments_12__sigma_0p0"
    deep = m(weights="/a/b/best.pth", method_config='{"lr":0.5,"deep":true,"name":null}')
    assert s(text.case_label(F.lit("x"), deep)) == "x__cfg_deep_True__cfg_lr_0p5__cfg_name_None__weights_bestppth"
    assert s(text.study_label(F.lit("x"), m(ssn_weights="/a/b.pth"))) == "x__ssn_weights_a_bppth"
    assert s(text.neural_case_params(F.lit('{"b":1,"a":"x","weights":"/w.pth"}'))) == {"method_config": '{"a":"x","b":1}', "weights": "/w.pth"}
    assert s(text.neural_case_params(F.lit('{"weight_path":" "}'))) == {} and s(text.neural_case_params(F.lit("[1]"))) is None
    assert s(text.method_key(F.concat(F.lit("M"), F.repeat(F.lit("_1"), 1500))))["args"] == [1.0] * 1500


def test_families_and_statuses(spark):
    paths = ["/r/Sweeps/a", "/r/refinement/x", "/r/training/smoke_1", "/r/training/x", "/r/interactive_runs/a_smoke", "/r/interactive_runs/_quarter_run", "/r/debug/smoke", "/r/uncategorized/debug/", "/r/precomputed/", "/r/sweepsy"]
    got = [(r.f, r.s) for r in spark.createDataFrame([(p,) for p in paths], "p string").select(bench.family(F.col("p")).alias("f"), bench.status(F.col("p")).alias("s")).collect()]
    assert got == [
        ("sweep", "archive"), ("refinement", "archive"), ("training", "smoke"), ("training", "main"), ("interactive-run", "smoke"), ("interactive-run", "case-study"), ("debug", "debug"),
        ("debug", "uncategorized"), ("precomputed", "main"), ("uncategorized", "main"),
    ]


def test_leaderboard_ranks_only_what_is_ok(spark):
    rows_ = spark.createDataFrame([("a", 5, 0.5, "ok"), ("b", 5, None, "failed"), ("c", 5, 0.9, "failed"), ("d", 3, 0.9, "ok"), ("e", 5, 0.6, "ok")], "method string, budget int, mean_miou double, status string")
    assert [(r["rank"], r.method) for r in bench.leaderboard(rows_).orderBy("rank").collect()] == [(1, "e"), (2, "a")]


def test_metrics_on_empty_union_and_table(spark):
    cells = spark.createDataFrame([(0, 0, 5)], "gt int, pred int, n long")
    assert [tuple(r) for r in quality.summary(cells).select("accuracy", "miou").collect()] == [(1.0, 1.0)]
    empty = cells.limit(0)
    assert quality.class_metrics(empty).count() == 0
    assert rows(quality.summary(empty)) == {(None, 0.0)}


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    edges = [(g, rnd.randrange(60), rnd.randrange(60)) for g in (1, 2) for _ in range(35)] + [(3, i, i + 1) for i in range(40)]
    df = spark.createDataFrame(edges, "image int, u int, v int")
    nodes = df.select("image", F.col("u").alias("node")).union(df.select("image", "v"))
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, u, v in edges:
        a, b = find((g, u)), find((g, v))
        parent[max(a, b)] = min(a, b)
    assert rows(graph.components(nodes, df)) == {(g, n, find((g, n))[1]) for g, n in list(parent)}


def test_components_of_long_paths(spark):
    far = [*range(1, 300), 0]  # the least node at the far end
    mixed = random.Random(5).sample(range(3000), 3000)
    edges = [(g, a, b) for g, path in ((1, far), (2, mixed)) for a, b in zip(path, path[1:])]
    df = spark.createDataFrame(edges, "image int, u int, v int")
    nodes = df.select("image", F.col("u").alias("node")).union(df.select("image", "v"))
    assert rows(graph.components(nodes, df)) == {(1, n, 0) for n in far} | {(2, n, 0) for n in mixed}


def test_cleanup_is_sequential(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 0), (1, 9, 5)], "image int, sp long, label int")
    edges = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 2, 2), (1, 2, 3, 1)], "image int, u long, v long, w long")
    got = dict(rows(graph.cleanup(labels, edges, 1), "sp", "clean"))
    # 0 takes the label of 1; then 1, which has only 2 of another label around it, takes that of 2.
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 9: 5}


def test_cleanup_gathers_only_what_can_change(spark, monkeypatch):
    def brute(label, w, limit):
        label, done = dict(label), set()
        for start in sorted(label):
            part, todo, own = [], [] if start in done else [start], label[start]
            while todo:
                u = todo.pop()
                if u not in done and label[u] == own:
                    done.add(u)
                    part.append(u)
                    todo += [b for a, b in w if a == u]
            near = {}
            for (a, b), n in w.items():
                if a in part and label[b] != own:
                    near[label[b]] = near.get(label[b], 0) + n
            if near and len(part) <= limit:
                label.update(dict.fromkeys(part, max(near.items(), key=lambda x: (x[1], -x[0]))[0]))
        return label

    rnd = random.Random(4)
    graphs = [({u: rnd.randrange(3) for u in range(30)}, {(u, v): rnd.randint(1, 4) for u in range(30) for v in range(u + 1, 30) if rnd.random() < share}) for share in (0.05, 0.1, 0.3)]
    labels = spark.createDataFrame([(i, u, x) for i, (label, _) in enumerate(graphs) for u, x in label.items()], "image int, sp long, label int")
    edges = spark.createDataFrame([(i, u, v, n) for i, (_, w) in enumerate(graphs) for (u, v), n in w.items()], "image int, u long, v long, w long")
    for limit in (1, 3):
        want = {(i, u, x) for i, (label, w) in enumerate(graphs) for u, x in brute(label, w | {(v, u): n for (u, v), n in w.items()}, limit).items()}
        assert rows(graph.cleanup(labels, edges, limit), "image", "sp", "clean") == want

    kernel = graph._clean

    def watched(*args):
        run = kernel(*args)

        def few(pdf):
            assert len(pdf) <= 2
            return run(pdf)

        return few

    monkeypatch.setattr(graph, "_clean", watched)
    labels = spark.createDataFrame([(1, u, int(u in (7, 9))) for u in range(40)], "image int, sp long, label int")
    edges = spark.createDataFrame([(1, u, v, 1) for u in range(40) for v in range(u + 1, 40)], "image int, u long, v long, w long")
    assert graph.cleanup(labels, edges, 2).where("clean = 0").count() == 40


def watch_tables(monkeypatch):
    """The rows of what ``graph`` materialises, by its name."""
    written = {}

    def noted(df, what):
        out = storage.materialise(df, what)
        written[what] = max(written.get(what, 0), out.count())
        return out

    monkeypatch.setattr(graph, "materialise", noted)
    return written


def test_cleanup_writes_no_edges_again(spark, monkeypatch):
    written = watch_tables(monkeypatch)
    labels = spark.createDataFrame([(1, u, u % 3, 0, 5, 0.1) for u in range(40)], "image int, sp long, label int, base int, n long, conf double")
    edges = spark.createDataFrame([(1, u, v, 1) for u in range(40) for v in range(u + 1, 40)], "image int, u long, v long, w long")
    edges = storage.materialise(edges, "edges")
    assert graph.cleanup_conservative(labels, edges, 3).where("clean = label").count() == 40
    assert written and max(written.values()) <= 3 * 40  # a row for each label around a region at most


def test_smooth_writes_no_edges_again(spark, monkeypatch):
    written = watch_tables(monkeypatch)
    scores = spark.createDataFrame([(1, u, 0.5, 0.3, 0.2) for u in range(40)], "image int, sp long, s0 double, s1 double, s2 double")
    edges = spark.createDataFrame([(1, u, v, 1) for u in range(40) for v in range(u + 1, 40)], "image int, u long, v long, w long")
    out = graph.smooth(scores, storage.materialise(edges, "edges"), 2, 0.3)
    assert {(round(r.s0, 9), round(r.s1, 9), round(r.s2, 9)) for r in out.collect()} == {(0.5, 0.3, 0.2)} and out.count() == 40
    assert max(written.values()) <= 40


def test_boundaries_and_adjacency(spark):
    cells = [(1, x, y, int(x > 1), 0) for x in range(4) for y in range(3)]
    df = spark.createDataFrame(cells, "image int, x int, y int, sp int, gt int")
    assert rows(quality.adjacency(df)) == {(1, 0, 1, 3)}
    assert rows(quality.boundary_recall(df)) == {(1, 1.0)}
    assert df.withColumn("e", quality.edges(df, "sp")).where("e").count() == 6


def test_neighbours_of_a_written_table_are_counted_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAIR_ROWS", 60)
    rnd = random.Random(4)
    cells = [(i, x, y, rnd.choice([None, 0, 1, 2, 3])) for i in range(2) for x in range(16) for y in range(15) if rnd.random() < 0.9]
    df = spark.createDataFrame(cells, "image int, x int, y int, sp int")
    out = quality.adjacency(storage.materialise(df, "px"))
    assert rows(out) == rows(quality.adjacency(df)) and len(cells) // 60 > 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count(f", {len(cells) // 60}\n") == 2  # each direction by itself, in more tasks than usual


def test_shuffles_of_a_written_table_are_removed(spark):
    held = lambda: {f.split("_")[1] for f in re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" "))}
    before, flag = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(flag, "false")
    out = storage.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    deadline = time.time() + 10
    while held() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not held() - before and out.count() == 7 and spark.conf.get(flag) == "false"


def test_stalls_and_ema(spark):
    v = [0.1, 0.2, 0.2, 0.1, 0.3, 0.3]
    df = spark.createDataFrame([(1, i, x, 1.0) for i, x in enumerate(v)], "run int, step int, miou double, ink double")
    assert [r.stall for r in events.stalls(df).orderBy("step").collect()] == [0, 0, 1, 2, 0, 1]
    e = v[0]
    for x in v[1:]:
        e = 0.9 * e + 0.1 * x
    assert abs(events.ema(df).first().ema - e) < 1e-12


def test_logs_longer_than_a_span(spark, monkeypatch):
    rnd = random.Random(6)
    data = [(r, i, rnd.choice([0.1, 0.2, 0.3, None]), float(rnd.randrange(5))) for r in (1, 2, None) for i in range(40 if r == 1 else 7)]
    df = spark.createDataFrame(data, "run int, step int, miou double, ink double")
    want = {}
    for r in (1, 2, None):
        total, stall, before = 0.0, 0, None
        for n, (_, i, m, ink) in enumerate((x for x in data if x[0] == r), 1):
            total += ink
            rose = n == 1 or m is None or before is None or m > before
            stall = 0 if rose else stall + 1
            want[r, i] = n, total, rose, stall
            before = m
    for span in (1, 3, 8, 1 << 16):
        monkeypatch.setattr(events, "SPAN", span)
        cost = {(r.run, r.step): (r.n_scribbles, r.total_ink) for r in events.running_cost(df).collect()}
        rest = {(r.run, r.step): (r.progress, r.stall) for r in events.stalls(df).collect()}
        assert {k: (*cost[k], *rest[k]) for k in want} == want and len(cost) == len(want)
    assert {(r.run, r.step) for r in events.undo_last(df, 2).collect()} == {(r, i) for r, i, _, _ in data if i < (38 if r == 1 else 5)}


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5, None), ("b", float("nan"), 1.0)], "name string, x double, y double")
    got = {r["name"]: (r.x, r.y) for r in bench.with_mean_row(df, "name", ("x", "y")).collect()}
    assert got["MEAN"] == (0.5, 1.0)
    assert [r["name"] for r in bench.take_top(df, "x", 5, "name").collect()] == ["a"]
    lines = [r.line for r in bench.markdown_table(df, ["name", "y"], [F.col("name")]).orderBy("line_no").collect()]
    assert lines == ["| name | y   |", "| ---- | --- |", "| a    |     |", "| b    | 1.0 |"]


def test_text_functions(spark):
    one = spark.range(1)
    s = lambda c: one.select(c.alias("v")).first().v
    assert s(text.sanitize_token(F.lit("0.26-x y/é "))) == "0p26-x_y_é" and s(text.sanitize_token(F.lit(" /_ "))) == "x" and s(text.sanitize_token(F.lit(3.5))) == "3p5"
    assert s(text.csv_ints(F.lit("3, 1,,x,3"))) == [1, 3]
    assert s(text.hex_to_rgb(F.lit("#ff0080"))) == [1.0, 0.0, 128 / 255]
    assert s(text.human_size(F.lit(1536))) == "1.5 KB" and s(text.human_size(F.lit(5 * 1024**5).cast("double"))) == "5120.0 TB"
    assert s(text.tile_starts(F.lit(100), 40, 32)) == [0, 32, 60] and s(text.tile_starts(F.lit(10), 40, 32)) == [0]
    k = s(text.method_key(F.lit("SSN_500_0.26|/m/best.pth")))
    assert (k.family, k.args, k.weights) == ("ssn", [500.0, 0.26], "best.pth")
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 4.0), (3.0, 5.0))])
    assert s(text.polyline_length(pts)) == 6.0 and s(text.polyline_length(F.slice(pts, 1, 1))) == 0.0


def test_geometry_functions(spark):
    s = lambda c: spark.range(1).select(c.alias("v")).first().v
    a, b = geometry.box(F.lit(0.9), F.lit(-1), F.lit(0.1), F.lit(0.5)), geometry.box(F.lit(0.5), F.lit(0.5), F.lit(2), F.lit(1))
    assert tuple(s(a)) == (0.1, 0.0, 0.9, 0.5) and tuple(s(geometry.overlap(a, b))) == (0.5, 0.5, 0.9, 0.5)
    assert s(geometry.overlap(a, geometry.box(F.lit(0.95), F.lit(0), F.lit(1), F.lit(1)))) is None
    assert tuple(s(geometry.pixel_rect(a, 10, 5))) == (1, 0, 9, 2)
    assert tuple(s(geometry.to_pixel(F.lit(1.0), F.lit(0.5), 10, 11))) == (9, 5) and tuple(s(geometry.to_pixel(F.lit(1.0), F.lit(0.5), 10, 11, False))) == (9, 6)
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    boxes = F.array(geometry.box(F.lit(0.1), F.lit(0.1), F.lit(0.35), F.lit(0.3)), geometry.box(F.lit(0.35), F.lit(0.1), F.lit(0.6), F.lit(0.3)))
    assert s(geometry.covered(F.array(pt(0.2, 0.2), pt(0.35, 0.2), pt(0.5, 0.2)), boxes)) and not s(geometry.covered(F.array(pt(0.2, 0.2), pt(0.7, 0.2)), boxes))
    assert s(geometry.round_ring(F.lit(None).cast("array<struct<x:double,y:double>>"))) == []
    assert s(geometry.pulse(F.lit(4), 5)) == 1.0
    assert s(text.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert s(text.fixed(F.lit(None).cast("double"))) == "NaN" and s(text.fixed(F.lit(0.5), 2)) == "0.50"
