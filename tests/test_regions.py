import numpy as np
import pytest

from tessela.operators import raster, regions, soft


def rows_of(spark, name, *images):
    out = [(i, x, y, int(v)) for i, a in enumerate(images, 1) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(out, f"image int, x int, y int, {name} int")


def grid_of(df, col, shape, image=1):
    a = np.zeros(shape)
    for r in df.where(f"image = {image}").collect():
        a[r.y, r.x] = r[col]
    return a


def test_components_and_distances_equal_the_kernels(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (23, 31)), (rng.random((70, 9)) < 0.9).astype(int)
    df = rows_of(spark, "value", a, b)
    comp, dist = regions.components(df), regions.distance_inside(df, "value")
    whole = regions.components(df, zero=False)
    for i, m in enumerate((a, b), 1):
        assert (grid_of(comp, "comp", m.shape, i) == raster.label_components(m)).all()
        assert (grid_of(whole, "comp", m.shape, i) == raster.label_components(m, zero=False)).all()
        brute = raster.distance_inside(m)
        assert np.allclose(grid_of(dist, "dist", m.shape, i), brute)
    empty = df.limit(0)
    assert regions.components(empty).count() == regions.distance_inside(empty, "value").count() == 0
    assert [r.share for r in regions.normalised_distance(rows_of(spark, "dist", np.zeros((1, 2)))).collect()] == [0.0, 0.0]


def test_places_that_an_image_lacks_are_outside(spark):
    df = rows_of(spark, "value", np.ones((5, 5))).where("NOT (x = 2 AND y = 2)")
    d = grid_of(regions.distance_inside(df, "value"), "dist", (5, 5))
    assert d[2, 1] == 1 and d[0, 0] == 1 and d[1, 1] == pytest.approx(2**0.5)
    line = rows_of(spark, "value", np.ones((1, 5))).where("x <> 2")
    assert grid_of(regions.components(line), "comp", (1, 5)).tolist() == [[1, 1, 0, 2, 2]]


def test_disconnected_labels_are_split_and_thin_ones_merged(spark):
    two = np.zeros((8, 8), int)
    two[1:3, 1:3] = two[5:7, 5:7] = 7
    out = grid_of(regions.postprocess(rows_of(spark, "label", two), 2), "label", (8, 8))
    assert out[1, 1] > 0 and out[5, 5] > 0 and out[1, 1] != out[5, 5] and out[0, 0] == 0
    line = np.zeros((24, 24), int)
    line[3:20, 4:12], line[3:20, 12], line[3:20, 13:20] = 1, 2, 3
    out = grid_of(regions.postprocess(rows_of(spark, "label", line), 3, prune=True), "label", (24, 24))
    assert (out[3:20, 12] == out[3:20, 11]).all() and set(np.unique(out)) == {0, 1, 2}
    m = {r.label: (r.area, r.radius) for r in regions.measure(rows_of(spark, "label", line)).collect()}
    assert m == {1: (136, 4.0), 2: (17, 1.0), 3: (119, 4.0)}


def filled(ring, shape):
    return np.array([[regions._holds([(p["x"] * shape[1], p["y"] * shape[0]) for p in ring[:-1]], (x + 0.5, y + 0.5)) for x in range(shape[1])] for y in range(shape[0])])


def test_polygons_with_holes(spark):
    ring = np.zeros((10, 10), int)
    ring[1:9, 1:9] = 1
    ring[4:6, 4:6] = 0
    got = regions.polygons(rows_of(spark, "label", ring)).collect()
    assert len(got) == 1 and len(got[0].holes) == 1 and got[0].area == 60.0 and len(got[0].border) == 5
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, (14, 17))
    a[2:9, 2:12] = 1
    a[4, 4] = a[5, 5] = a[6, 4] = 0  # holes that touch in corners
    for r in regions.polygons(rows_of(spark, "label", a)).collect():
        comp = raster.label_components((a == r.label).astype(int))
        sizes = np.bincount(comp.ravel())[1:]
        drawn = filled(r.border, a.shape)
        for h in r.holes:
            drawn &= ~filled(h, a.shape)
        assert r.area == drawn.sum() == sizes.max() and (comp[drawn] == comp[drawn][0]).all()
    assert regions.polygons(rows_of(spark, "label", np.zeros((2, 2)))).count() == 0


def test_only_the_largest_part_is_outlined(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a = rng.integers(1, 4, (40, 11))
    a[3:35, 4] = 2  # across strips
    monkeypatch.setattr(regions, "PART_ROWS", 8)
    got = regions.largest_parts(rows_of(spark, "label", a)).collect()
    for label in (1, 2, 3):
        comp = raster.label_components((a == label).astype(int))
        size = np.bincount(comp.ravel())[1:].max()
        firsts = [(*min((x, y) for y, x in np.argwhere(comp == i)), i) for i in range(1, comp.max() + 1) if (comp == i).sum() == size]
        assert {(r.x, r.y) for r in got if r.label == label} == {(x, y) for y, x in np.argwhere(comp == min(firsts)[2])}
    outlined, seen = regions.outline_edges, []
    monkeypatch.setattr(regions, "outline_edges", lambda px, *rest: seen.append(px.count()) or outlined(px, *rest))
    dots = np.zeros((9, 9), int)
    dots[::2, ::2], dots[0, 1] = 1, 1
    assert [(r.area, len(r.border)) for r in regions.polygons(rows_of(spark, "label", dots)).collect()] == [(3.0, 5)] and seen == [3]


def test_simplify_and_sanitise(spark):
    p = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (2.0, 2.0), (0.0, 2.05), (0.0, 0.0)]
    assert regions.simplified(p, 1e-10) == [(0, 0), (2, 0), (2, 2), (0, 2.05), (0, 0)] and len(regions.simplified(p, 0.5)) == 5 and regions.simplified(p[:2], 1) == p[:2]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in p]), (2, None), (3, [{"x": 0.0, "y": 0.0}] * 3)], "id int, line array<struct<x:double,y:double>>")
    assert {r.id: r.line and len(r.line) for r in regions.simplify(df, "line").collect()} == {1: 5, 2: None, 3: 2}
    assert {r.id: r.ok and len(r.ok) for r in df.select("id", regions.sanitised(df["line"]).alias("ok")).collect()} == {1: 6, 2: None, 3: None}


def test_allowed_places_and_signatures(spark):
    gt = np.zeros((7, 7), int)
    gt[1:6, 1:6] = 1
    df = rows_of(spark, "gt", gt).selectExpr("*", "CASE WHEN x = 3 AND y = 3 THEN 1 ELSE 0 END AS pred", "x = 2 AND y = 2 AS used")
    got = {(r.x, r.y) for r in regions.allowed(df, 1, 1.5).collect()}
    assert got == {(x, y) for x in range(2, 5) for y in range(2, 5)} - {(3, 3), (2, 2)}
    sig = regions.signatures(df.where("gt = 1"), ("image", "gt")).first()
    assert tuple(sig) == (1, 1, 1, 1, 5, 5, 25)


def test_soft_assignment_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    h, w, n, rounds = 9, 14, 6, 3
    f = rng.normal(size=(2, h, w))
    df = spark.createDataFrame([(1, x, y, float(f[0, y, x]), float(f[1, y, x])) for y in range(h) for x in range(w)], "image int, x int, y int, f0 double, f1 double")
    nx, ny = int((n * w / h) ** 0.5), int((n * h / w) ** 0.5)
    cell = (np.arange(h)[:, None] * ny // h) * nx + np.arange(w)[None] * nx // w
    means = np.stack([np.bincount(cell.ravel(), f[i].ravel(), nx * ny) / (np.bincount(cell.ravel(), minlength=nx * ny) + 1e-6) for i in range(2)])
    for _ in range(rounds):
        a = np.zeros((h, w, nx * ny))
        for y in range(h):
            for x in range(w):
                near = [c for c in range(nx * ny) if abs(c % nx - cell[y, x] % nx) <= 1 and abs(c // nx - cell[y, x] // nx) <= 1]
                e = np.exp([-((f[:, y, x] - means[:, c]) ** 2).sum() for c in near])
                a[y, x, near] = e / e.sum()
        means = np.einsum("yxc,fyx->fc", a, f) / (a.sum((0, 1)) + 1e-6)
    s = soft.assign(df, ["f0", "f1"], n, rounds)
    for r in s.collect():
        assert abs(r.a - a[r.y, r.x, r.seg]) < 1e-9
    assert (grid_of(soft.hard_labels(s), "seg", (h, w)) == a.argmax(-1)).all()
    again = np.einsum("yxc,fc->fyx", a, means)
    assert soft.reconstruction_mse(s, ["f0", "f1"]).first().mse == pytest.approx(((again - f) ** 2).mean(), abs=1e-9)
    use = a.mean((0, 1))
    ent = -(np.where(a > 0, np.maximum(a, 1e-6) * np.log(np.maximum(a, 1e-6)), 0)).sum(-1).mean() + 0.2 * (np.maximum(use, 1e-6) * np.log(np.maximum(use, 1e-6))).sum()
    assert soft.rim_loss(s).first().rim == pytest.approx(ent, abs=1e-9)
    tv = (np.abs(np.diff(f[0], axis=1)) * np.exp(-4 * np.abs(np.diff(f[1], axis=1)))).mean() + (np.abs(np.diff(f[0], axis=0)) * np.exp(-4 * np.abs(np.diff(f[1], axis=0)))).mean()
    assert soft.variation(df, "f0", ["f1"]).first().tv == pytest.approx(tv, abs=1e-9)
    assert soft.assign(df.limit(0), ["f0", "f1"], n, 1).count() == 0


def test_masks_with_holes_are_split():
    m = np.ones((40, 40), int)
    m[10:14, 8:30] = m[25:28, 25:28] = 0
    parts = raster.split_holes(m, 20)
    assert len(parts) >= 3 and all(not raster.holes(p).any() for p in parts) and (np.any(parts, axis=0) == (m > 0)).all()
    assert raster.split_holes(np.zeros((3, 3))) == [] and len(raster.split_holes(np.ones((3, 3)))) == 1
