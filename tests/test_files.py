import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tessela import sinks
from tessela.operators import raster
from tessela.plans import adapters
from tessela.sources import images, logs, states
from tessela.sources.tables import small_text_files


def paths(spark, names):
    return spark.createDataFrame([(n, 3) for n in names], "path string, size_bytes long")


def test_pairs_prefer_the_same_name(spark):
    a = paths(spark, ["/i/a.jpg", "/i/b.png", "/i/c.bmp", "/i/d.txt", "/i/b.png"])
    m = paths(spark, ["/m/a.tif", "/m/a.png", "/m/a.jpg", "/m/b.tif", "/m/b.jpg", "/m/x.png"])
    assert rows(images.pair(a, m)) == {("/i/a.jpg", "/m/a.jpg"), ("/i/b.png", "/m/b.jpg")}
    assert rows(images.pairing_errors(a, m)) == {("a", "repeated"), ("b", "repeated"), ("c", "no mask"), ("x", "no image")}


def test_state_listing(spark):
    f = paths(spark, ["/r/one/state_2.json", "/r/one/state_10.json.gz", "/r/one/other.json", "/r/two/state_x.json"])
    assert rows(images.latest_states(f)) == {("/r/one", "/r/one/state_10.json.gz", 10), ("/r/two", "/r/two/state_x.json", -1)}
    assert rows(images.inventory(f, "/r")) == {("one", 3, 9), ("two", 1, 3)}


def test_metric_csv(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "metrics.csv").write_text("step,miou,iou_a,iou_b\n0,0.1,,0.5\nx,0.9,1,1\n1,nan,0.2,abc\n1,0.3,0.25,\n")
    raw = logs.metric_csv(spark, str(tmp_path / "*" / "metrics.csv"))
    assert rows(logs.by_step(raw, ("miou", "iou_a"))) == {("run1", 0, 0.1, None), ("run1", 1, 0.3, 0.25)}
    assert ("run1", "0", "b", 0.5) in rows(logs.unpivot_classes(raw), "run", "step", "class", "value")


def test_run_log_and_help(spark):
    lines = [("r", 1, "2024-01-01 10:00:00 start image=/d/imgs/x.jpg"), ("r", 2, "ERROR oops"), ("r", 3, "2024-01-01 10:01:30 end image=y"), ("s", 1, "nothing"), ("s", 2, None)]
    got = {r.run: r for r in logs.run_log(spark.createDataFrame(lines, "run string, line_no int, line string")).collect()}
    assert (got["r"].n_errors, got["r"].image, got["r"].duration_s) == (1, "/d/imgs/x.jpg", 90) and got["s"].started is None
    text = spark.createDataFrame([("a.py", "usage: a\n\noptions:\n  -h, --help            show this\n  --size SIZE           the size\n                        of it\n")], "script string, text string")
    assert rows(logs.help_options(text)) == {("a.py", "-h", "show this"), ("a.py", "--size", "the size of it")}
    assert spark.range(1).select(logs.mask_of_image(F.lit("/d/imgs/a.b.jpg"))).first()[0] == "/d/masks/a.b.png"


def test_states_and_violations(spark):
    sp = [{"id": 1, "border": [[0, 0], [0, 1], [1, 1]], "holes": [[[0, 0]], [[0, 0], [0, 1], [1, 1]]], "parents": [4, 2]}, {"id": 1, "border": [[0, 0]]}]
    an = [{"id": 7, "code": 2, "parent_superpixel": 1}, {"id": 8, "code": 2, "parent_superpixel": 1, "parent_intersect": False}, {"id": 9}]
    docs = spark.createDataFrame([(1, json.dumps({"_meta": {"magic": "x", "version": 9, "image": {"size_wh": [4, 5]}}, "superpixels": {"m": sp}, "annotations": {"m": an}})), (2, '{"scribbles":[]}'), (3, None)], "record_id long, doc_json string")
    s = states.states(docs)
    assert rows(s, "record_id", "magic", "version", "width") == {(1, "x", 9, 4), (2, "spanno", 1, None)}
    assert rows(states.superpixels(s)) == {(1, "m", 1, 3, 1, 2), (1, "m", 1, 1, 0, None)}
    assert rows(states.violations(s)) == {(1, "header", None, None), (1, "repeated superpixel", "m", 1), (1, "short border", "m", 1), (1, "no superpixel", "m", 9), (1, "several annotations", "m", 1)}
    again = states.states(states.to_documents(states.superpixels(s).dropDuplicates(["id"]), states.annotations(s)))
    assert states.annotations(again).count() == 3 and again.first().version == 3


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "b int, a string"), spark.createDataFrame([(2, 0.5)], "b int, c double")
    assert sinks.write_csv(str(tmp_path / "t"), a, b, files=1) == ["b", "a", "c"]
    assert sinks.write_csv(str(tmp_path / "u"), a, b, sort_columns=True) == ["a", "b", "c"]
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    sinks.write_json(str(tmp_path / "j"), a)
    assert small_text_files(spark, str(tmp_path / "t") + "/*.csv").count() == 1
    sinks.write_text(str(tmp_path / "l"), spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    px = spark.createDataFrame([(1, 2, 3), (2, 2, 3)], "image int, sp int, v int")
    sinks.write_pixels(str(tmp_path / "p"), px)
    assert rows(spark.read.parquet(str(tmp_path / "p")), "image", "sp") == {(1, 2), (2, 2)}


def test_distance_equals_brute_force():
    rng = np.random.default_rng(3)
    m = rng.random((13, 17)) < 0.8
    p = np.pad(m, 1)
    out = np.argwhere(~p)
    want = np.array([[np.sqrt(((out - [y + 1, x + 1]) ** 2).sum(1)).min() if m[y, x] else 0 for x in range(17)] for y in range(13)])
    assert np.allclose(raster.distance_inside(m), want)


def test_components_holes_and_cleaning():
    m = np.zeros((12, 12), int)
    m[1:8, 1:8] = 1
    m[3:5, 3:5] = 0
    m[9, 10] = 1
    assert raster.label_components(m).max() == 2 and raster.holes(m).max() == 1 and (raster.holes(m) > 0).sum() == 4
    assert raster.drop_small(m, 5).sum() == 45 and raster.close_open(m)[9, 10] == 0
    assert set(np.unique(raster.grid_segments(np.zeros((12, 12)), 4))) == {1, 2, 3, 4}


def test_rasters_on_tables(spark):
    cells = [(1, x, y, int(x < 3)) for x in range(5) for y in range(4)]
    df = spark.createDataFrame(cells, "image int, x int, y int, m int")
    got = {(r.x, r.y): r.d for r in raster.per_image(df, raster.distance_inside, "m", "d", "double").collect()}
    assert got[1, 1] == 2.0 and got[4, 0] == 0.0 and len(got) == 20
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0)], "id int, pos int, x double, y double")
    assert raster.stamp_segments(pts, 1).count() == 7 * 3


def test_polygons(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    r = spark.range(1).select(raster.ring_area(ring).alias("a"), raster.in_ring(F.lit(1.0), F.lit(1.0), ring).alias("i"), raster.in_ring(F.lit(5.0), F.lit(1.0), ring).alias("o"), raster.ring_box(ring).alias("b"),
                              raster.segment_distance(F.lit(0.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0)).alias("s")).first()
    assert (r.a, r.i, r.o, tuple(r.b), r.s) == (8.0, True, False, (0.0, 4.0, 0.0, 2.0), 3.0)


def test_adapters(spark):
    assert not adapters.register(adapters.create("MOCK_BOX"))
    with pytest.raises(KeyError):
        adapters.create("nothing")
    assert rows(adapters.availability(spark, ["mock_box", "nothing"]), "method_id", "available", "reason") == {("mock_box", True, ""), ("nothing", False, "unknown")}
    p = spark.createDataFrame([("a", 1, 2, 0.5, None), ("a", 1, 1, 0.5, None), ("a", 1, 0, 0.5, -1.0), ("a", 2, 5, 0.1, 0.2)], "image string, interaction_id int, candidate_id int, iou double, score double")
    assert rows(adapters.best_proposals(p), "interaction_id", "candidate_id") == {(1, 0), (2, 5)}
