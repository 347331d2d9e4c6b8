import json
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tessela.functions import colour, layout, prompts
from tessela.operators import bench, events
from tessela.plans import adapters
from tessela.sources import logs, masks, states


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def filtered_png(a, how, depth=8, colour_type=0):
    """A PNG whose every line is filtered one way."""
    h, w = a.shape[:2]
    data = a.reshape(h, -1)
    if depth == 16:
        data = data.astype(">u2").view(np.uint8).reshape(h, -1)
    elif depth < 8:
        bits = ((data[:, :, None] >> np.arange(depth)[::-1]) & 1).reshape(h, -1).astype(np.uint8)
        data = np.packbits(bits, axis=1)
    data = data.astype(np.uint8)
    n = max(1, {0: 1, 2: 3, 3: 1, 6: 4}[colour_type] * depth // 8)
    lines, before = [], np.zeros(data.shape[1], int)
    for line in data.astype(int):
        left, corner = np.r_[np.zeros(n, int), line[:-n]], np.r_[np.zeros(n, int), before[:-n]]
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        near = [0, left, before, (left + before) // 2, paeth][how]
        lines.append(bytes([how]) + ((line - near) % 256).astype(np.uint8).tobytes())
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return masks.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour_type, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png_in_all_filters_and_depths():
    rng = np.random.default_rng(1)
    for how in range(5):
        for depth in (1, 2, 4, 8, 16):
            a = rng.integers(0, 1 << depth, (7, 13))
            assert (masks.decode_png(filtered_png(a, how, depth))[..., 0] == a).all(), (how, depth)
        rgb = rng.integers(0, 256, (5, 6, 3))
        assert (masks.decode_png(filtered_png(rgb, how, 8, 2)) == rgb).all() and (masks.decode_png(masks.encode_png(rgb)) == rgb).all()
    for bad in (b"", b"GIF", masks.encode_png(np.zeros((4, 4)))[:50]):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            masks.decode_png(bad)


def test_masks_as_files_and_back(spark, tmp_path):
    a = np.arange(30).reshape(5, 6) * 8
    px = spark.createDataFrame([(f"/d/{n}.jpg", x, y, int(v)) for n in "ab" for (y, x), v in np.ndenumerate(a)], "image string, x int, y int, code int")
    assert masks.write_masks(px, str(tmp_path)).count() == 2
    (tmp_path / "broken.png").write_bytes(b"no")
    back = masks.mask_codes(spark.read.format("binaryFile").load(str(tmp_path / "*.png")).select("path", "content", "length"))
    got = {(r.image.rsplit("/", 1)[1], r.x, r.y, r.code) for r in back.collect()}
    assert got == {(f"{n}.png", x, y, int(v)) for n in "ab" for (y, x), v in np.ndenumerate(a)} | {("broken.png", -1, -1, -1)}


def test_resizing_padding_and_tiles(spark):
    a = np.arange(35).reshape(5, 7)
    px = spark.createDataFrame([(1, x, y, int(v)) for (y, x), v in np.ndenumerate(a)], "image int, x int, y int, code int")
    for w, h in ((7, 5), (3, 2), (20, 11), (1, 1)):
        got = np.full((h, w), -1)
        for r in masks.resize(px, spark.createDataFrame([(1, w, h), (2, 3, 3)], "image int, w int, h int")).collect():
            got[r.y, r.x] = r.code
        want = a[np.floor((np.arange(h) + 0.5) * 5 / h).astype(int)][:, np.floor((np.arange(w) + 0.5) * 7 / w).astype(int)]
        assert (got == want).all()
    padded = np.full((8, 8), -1)
    for r in masks.pad(px, 4).collect():
        padded[r.y, r.x] = r.code
    assert (padded == np.pad(a, ((0, 3), (0, 1)), mode="edge")).all() and rows(masks.pad(px, 1)) == rows(px)
    t = masks.tiled(px, 4, 3).withColumn("v", F.col("code") + F.col("tx"))
    assert rows(t.select("tx", "ty").distinct()) == {(x, y) for x in (0, 3) for y in (0, 1)}
    assert {(r.x, r.y): r.v for r in masks.untiled(t, ["v"]).collect()}[3, 2] == 17 + 1.5


def test_tiles_of_long_images(spark):
    px = spark.range(3).select(F.lit(1).alias("image"), F.lit(0).alias("x"), (F.col("id") * 999_999_999).alias("y"))
    for size, stride in ((4, 3), (2, 5), (7, 2), (5, 5)):  # a list of all starts would have hundreds of millions
        last = 2 * 999_999_999 + 1 - size
        want = {(y, s) for y in (0, 999_999_999, 1_999_999_998) for s in {*[v for v in range(max(0, y - size - stride), y + 1) if v % stride == 0 and v <= last], last} if s <= y < s + size}
        assert rows(masks.tiled(px, size, stride), "y", "ty") == want
    assert rows(masks.untiled(masks.tiled(px, 4, 3).withColumn("v", F.lit(2)), ["v"], "n").where("y = 0"), "v", "n") == {(2.0, 1)}


def test_colours(spark):
    lab = value(spark, colour.rgb_to_lab(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert (round(lab.l, 6), lab.a, lab.b) == (100.0, 0.0, 0.0)
    red = value(spark, colour.lab_to_rgb(*[F.lit(v) for v in (53.3, 80.0, 67.0)]))
    assert red.r > 0.98 and red.g < 0.05 and red.b < 0.05
    infos = colour.class_infos([4, 9])
    assert infos[1] == {"index": 1, "code": 9, "name": "class_9", "rgb": [255, 165, 0]} and len(colour.palette(0)) == 1 and len(set(colour.palette(40))) == 40
    assert value(spark, colour.remap(F.lit(9), infos)) == 1 and value(spark, colour.remap(F.lit(None).cast("int"), infos)) == -1 and value(spark, colour.decode(F.lit(7), infos)) is None
    assert value(spark, colour.blend(F.array(F.lit(100), F.lit(0)), F.array(F.lit(200), F.lit(255)), 0.5)) == [150, 127]
    s = spark.createDataFrame([("a", 1, 0.5), ("b", 1, float("nan")), ("c", 1, None)], "class string, step int, value double")
    shown = lambda m: {r["class"] for r in colour.present_classes(s, m).collect()}
    assert shown(None) == {"a"} and shown(spark.createDataFrame([("b",)], "class string")) == {"b"} and shown(spark.createDataFrame([("z",)], "class string")) == {"a"}


def test_events_with_direct_and_propagated(spark):
    # Two saved states of one run, with one scribble and then three; of the second's annotations one is met by a scribble and one is not.
    st = spark.createDataFrame([("r", 1), ("r", 3), ("r", 3), ("q", 5)], "run string, index int")
    sc = spark.createDataFrame([("r", 1, 1), ("r", 3, 1), ("r", 3, 2), ("r", 3, 3), ("r", 3, 3), ("r", 3, None)], "run string, index int, sid int")
    an = spark.createDataFrame(
        [("r", 1, 1, 1, True, [1]), ("r", 3, 1, 1, True, [1]), ("r", 3, 2, 1, True, [2]), ("r", 3, 3, 1, False, [2]), ("r", 3, 3, 1, False, [2])],
        "run string, index int, sp int, code int, direct boolean, parents array<int>",
    )
    got = {(r.run, r["index"]): r for r in events.build_events(st, sc, an).collect()}
    a, b, c = got["r", 1], got["r", 3], got["q", 5]
    assert (a.prev_step, a.cur_step, a.step_delta, a.exact, a.new_scribbles, a.direct_sps, a.propagated_sps) == (0, 1, 1, True, [1], [1], [])
    assert (b.prev_step, b.cur_step, b.step_delta, b.exact, b.new_scribbles, b.direct_sps, b.propagated_sps) == (1, 3, 2, False, [2, 3], [2], [3])
    assert (c.cur_step, c.step_delta, c.exact, c.direct_sps) == (0, 0, False, [])
    assert events.build_events(st.limit(0), sc, an).count() == 0


def test_states_migrated_and_put_together(spark):
    doc = {"scribbles": [{"id": 1, "points": [[0.1, 0.20]], "params": {"code": 2}}], "superpixels": {"m\"1": [{"id": 7, "border": [[0, 0], [1, 0], [1, 1]], "holes": [], "parents": [3], "props": [0.5]}]}, "annotations": {"m\"1": [{"id": 7, "code": 2, "x": {"y": None}}], "b": []}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"scribbles":[]}')], "record_id long, doc_json string")
    first = states.states(df)
    again = {r.record_id: json.loads(r.doc_json) for r in states.documents(states.full_items(first), first.select("record_id", "width", "height")).collect()}
    assert again[1]["scribbles"] == doc["scribbles"] and again[1]["superpixels"] == doc["superpixels"] and again[1]["annotations"] == {"m\"1": doc["annotations"]["m\"1"]}
    assert again[1]["_meta"]["checks"] == {"n_scribbles": 1, "n_superpixels": {"m\"1": 1}, "n_annotations": {"m\"1": 1}} and again[2]["scribbles"] == [] and again[2]["_meta"]["magic"] == states.MAGIC
    old = json.loads(value(spark, states.migrated(F.lit(json.dumps(doc)))))
    assert old["_meta"]["version"] == 1 and old["_meta"]["methods"] == ["m\"1"] and old["scribbles"] == doc["scribbles"] and json.loads(value(spark, states.migrated(F.lit("{}"))))["_meta"]["methods"] == []
    assert value(spark, states.chosen_method(F.lit(json.dumps(doc)), "b")) == "b" and value(spark, states.chosen_method(F.lit(json.dumps(doc)), "z")) is None and value(spark, states.chosen_method(F.lit(json.dumps(doc)))) == "b"
    late = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "new", 2)], "record_id long, doc_json string, received_at int")
    assert rows(states.latest(late)) == {(1, "new")}
    assert rows(states.scribbles(first)) == {(1, 1, 2, 1)}
    s = value(spark, states.json_summary(F.lit('{"methods":{"b":{"miou":0.5},"a":{"miou":0.5},"c":{}},"n_images":3}')))
    assert (s.method_count, s.best_method, s.best_miou, s.n_images, s.before_miou) == (3, "a", 0.5, 3, None)
    assert value(spark, states.json_summary(F.lit("[1]"))) is None


def test_layout(spark):
    kind = lambda n, d, **kw: value(spark, layout.top_level_kind(F.lit(n), F.lit(d), **kw))
    assert kind("docs", True) == "docs" and kind("a.ckpt", False) == "models" and kind("_tmp_quarter_spanno", True) == "artifacts" and kind("lib", True, core=["lib"]) == "core" and kind("lib", True) == "uncategorized"
    target = lambda n, d, **kw: value(spark, layout.top_level_target(F.lit(n), F.lit(d), **kw))
    assert target("_tmp_quarter_spanno", True) == "artifacts/precomputed/_tmp_quarter_spanno" and target("_tmp_quarter_x", True) == "artifacts/debug/_tmp_quarter_x" and target("out", True) is None and target("x.py", False) is None
    assert target("log", True) == "artifacts/debug/log" and target("lib", True, core=["lib"]) is None
    assert value(spark, layout.ignored(F.lit("a.venv"))) and not value(spark, layout.ignored(F.lit("src"))) and value(spark, layout.relative(F.lit("/a//b/c"), "/a/b/")) == "c" and value(spark, layout.relative(F.lit("/ab/c"), "/a")) is None
    with pytest.raises(ValueError):
        layout.video_target(F.lit("x"), "o.mp4")
    assert value(spark, layout.command(["p", "run"], F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(None).cast("string")))) == ["p", "run", "--b", "2"]


def test_prompts(spark):
    pts = F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(0.0).alias("y")) for i in range(5)])
    xs = lambda k, p=pts: value(spark, F.transform(prompts.prompt_points(F.lit(k), p), lambda q: q["x"]))
    assert xs("POINT") == [2.0] and xs("line") == [0.0, 4.0] and xs("mark") == [0, 1, 2, 3, 4] and xs("box") is None and xs("point", F.slice(pts, 1, 0)) == [] and xs("line", F.slice(pts, 1, 1)) == [0.0]
    assert value(spark, prompts.arm_balance(pts, F.lit(1))) == pytest.approx(1 / 3) and value(spark, prompts.arm_balance(F.slice(pts, 1, 1), F.lit(0))) == 0.0
    p = lambda **k: value(spark, prompts.propagation_profiles(*[F.lit(k.get(n, v)) for n, v in (("sens", 2.0), ("iou", 0.0), ("n", 0), ("all", 0), ("classes", 3))], embeddings=k.get("emb", False)))
    assert p(sens=0.0) == [] and len(p()) == 1 and [round(x.sens, 6) for x in p(iou=0.7, n=4)] == [0.9, 1.2] and [x.embedding_threshold for x in p(all=6, n=3, emb=True)] == [1.0, 0.99]
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    cross = lambda *q: value(spark, prompts.segments_cross(*[at(*v) for v in q]))
    assert cross((0, 0), (2, 2), (0, 2), (2, 0)) and cross((0, 0), (2, 0), (1, 0), (1, 5)) and not cross((0, 0), (1, 0), (2, 0), (3, 0)) and cross((0, 0), (2, 0), (1, 0), (3, 0)) and not cross((0, 0), (1, 1), (2, 0), (3, 3))
    assert value(spark, prompts.metrics_footer(*[F.lit(None).cast("double")] * 4, F.lit(True))).startswith("New annotations briefly")


def test_trials_logs_and_external_methods(spark):
    t = bench.suggest(spark, {"a": (10.0, 1000.0, "log"), "b": (5, 500, 5), "c": ["x", "y"], "d": (0.0, 3.0)}, 500, seed=3)
    got = t.collect()
    assert all(10 <= r.a <= 1000 and r.b in range(5, 501, 5) and 0 <= r.d <= 3 for r in got) and {r.c for r in got} == {"x", "y"} and 0.4 < np.mean([r.a < 100 for r in got]) < 0.6
    assert t.collect() == got and {r.trial for r in bench.best_trials(t.withColumn("score", F.col("d")), "c").collect()} == {max((r for r in got if r.c == c), key=lambda r: r.d).trial for c in "xy"}
    g = spark.createDataFrame([("h", "1, 20\n\n1,5\nx, 3\n2")], "host string, text string")
    assert rows(logs.gpu_memory(g)) == {("h", 1, 25)}
    assert value(spark, logs.resident_bytes(F.lit("Name: x\nVmRSS:\t  12 kB"))) == 12288 and value(spark, logs.resident_bytes(F.lit(""))) == 0
    code = "import sys,json\nfor l in sys.stdin:\n r=json.loads(l); print(json.dumps({'image':r['image'],'interaction_id':r['interaction_id'],'class_id':r['class_id'],'candidate_id':0,'kind':'dot','cx':r['x'],'cy':r['y'],'size':r['radius'],'score':1.0}))"
    adapters.register(adapters.external("echo_dot", [sys.executable, "-c", code], ("point",)))
    p = spark.createDataFrame([("i", 1, 2, "point", 0.25, 0.5, 0.1), ("i", 2, 2, "box", 0.25, 0.5, 0.1)], "image string, interaction_id int, class_id int, prompt_type string, x double, y double, radius double")
    assert rows(adapters.predict(p, "echo_dot")) == {("i", 1, 2, 0, "dot", 0.25, 0.5, 0.1, 1.0)}
    assert not adapters.external("absent", ["no-such-program"]).available
    payload = json.loads(adapters.runtime_payload(p).first().payload)
    assert payload["step"] == 2 and [x["interaction_id"] for x in payload["prompts"]] == [1, 2] and adapters.history(p, 2).first().interactions == [1, 2]
