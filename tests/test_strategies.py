import random

import numpy as np
import pytest

from tests.conftest import rows
from tessela.operators import quality, strategies, votes
from tessela.operators.raster import close_open

SCHEMA = "image int, x int, y int, sp int, gt int, lg0 double, lg1 double, lg2 double, valid boolean, pred int"


def pixels(spark, logits, sp, image=1):
    """Rasters of logits (class, y, x) and regions as rows."""
    out = []
    for (y, x), s in np.ndenumerate(sp):
        lg = [float(v) for v in logits[:, y, x]] + [-50.0] * (3 - len(logits))
        out.append((image, x, y, int(s), 0, *lg, True, int(np.argmax(lg))))
    return spark.createDataFrame(out, SCHEMA)


def brute(lg, sp, s):
    """The whole of a strategy on one image, with numpy."""
    k, (h, w) = lg.shape[0], sp.shape
    flat, n_sp = sp.ravel(), sp.max() + 1
    e = np.exp(lg - lg.max(0))
    p = (e / e.sum(0)).reshape(k, -1)
    own, ranked = p.argmax(0), np.sort(p, 0)
    conf, margin, entropy = ranked[-1], ranked[-1] - ranked[-2], -(p * np.log(np.maximum(p, 1e-8))).sum(0) / np.log(k)
    n = np.bincount(flat, minlength=n_sp)
    mean = lambda v, weight: np.bincount(flat, v * weight, n_sp) / np.maximum(np.bincount(flat, weight, n_sp), 1e-6)
    norm = lambda v: np.maximum(v, 1e-8) / np.maximum(v, 1e-8).sum(0)
    count = lambda label: np.stack([np.bincount(flat, label == c, n_sp) for c in range(k)])
    if s.aggregate_mode == "majority_argmax":
        score = norm(count(own).astype(float))
    else:
        if s.aggregate_mode == "logit_mean":
            m = np.stack([mean(lg[c].ravel(), np.ones(h * w)) for c in range(k)]) / s.temperature
            score = np.exp(m - m.max(0)) / np.exp(m - m.max(0)).sum(0)
        else:
            t = np.maximum(p, 1e-8) ** (1 / s.temperature)
            weight = {"mean_proba": np.ones(h * w), "confidence_weighted_mean": conf, "margin_weighted_mean": margin, "entropy_weighted_mean": 1 - entropy}[s.aggregate_mode]
            score = np.stack([mean(v, np.maximum(np.maximum(weight, 1e-6) ** s.weight_power, 1e-6)) for v in t / t.sum(0)])
        score = norm(score / np.maximum(p.mean(1), 1e-6)[:, None] ** s.prior_power)
    near = [{} for _ in range(n_sp)]
    for a, b in [*zip(sp[:, :-1].ravel(), sp[:, 1:].ravel()), *zip(sp[:-1].ravel(), sp[1:].ravel())]:
        if a != b:
            near[a][b] = near[a].get(b, 0) + 1
            near[b][a] = near[b].get(a, 0) + 1
    for _ in range(s.graph_steps):
        score = norm(np.stack([(1 - s.graph_alpha) * score[:, u] + s.graph_alpha * sum(score[:, v] * w_ for v, w_ in near[u].items()) / sum(near[u].values()) if near[u] else score[:, u] for u in range(n_sp)], 1))
    label, sure, base = score.argmax(0), score.max(0), count(own).argmax(0)
    top = np.sort(score, 0)
    changed = own != label[flat]
    ok = top[-1] - top[-2] >= s.min_superpixel_margin
    if s.enforce_superpixel_confidence_guard:
        ok &= sure >= s.superpixel_confidence_threshold
    moved = np.bincount(flat, changed, n_sp)
    ok &= moved / np.maximum(n, 1) <= s.max_change_fraction
    if s.max_changed_mean_confidence < 1:
        ok &= (moved == 0) | (np.bincount(flat, conf * changed, n_sp) / np.maximum(moved, 1) <= s.max_changed_mean_confidence)
    unsure = conf < s.pixel_confidence_threshold
    take = {
        "all": np.ones(h * w, bool), "low_pixel_conf": unsure, "disagree_low_pixel_conf": changed & unsure, "high_sp_conf": (sure >= s.superpixel_confidence_threshold)[flat],
        "changed_high_sp_conf": ((base != label) & (sure >= s.superpixel_confidence_threshold))[flat],
    }[s.overwrite_policy]
    out = np.where(take & ok[flat], label[flat], own)
    if s.cleanup_mode == "none":
        return out.reshape(h, w)
    new, seen = count(out).argmax(0), set()
    stage = new.copy()
    for start in range(n_sp):
        if start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            u = todo.pop()
            part.append(u)
            for v in near[u]:
                if v not in seen and new[v] == new[start]:
                    seen.add(v)
                    todo.append(v)
        if len(part) > s.small_component_superpixels:
            continue
        if s.cleanup_mode == "conservative" and (not (stage != base)[part].any() or (sure[part] * n[part]).sum() / n[part].sum() >= s.superpixel_confidence_threshold):
            continue
        votes_ = {}
        for u in part:
            for v, w_ in near[u].items():
                if v not in part and new[v] != new[start]:
                    votes_[new[v]] = votes_.get(new[v], 0) + w_
        if votes_:
            best, most = max(votes_.items(), key=lambda x: (x[1], -x[0]))
            if s.cleanup_mode == "simple" or most / sum(votes_.values()) >= s.neighbor_ratio_threshold:
                new[part] = best
    return new[flat].reshape(h, w)


def test_catalog():
    novel = strategies.generated(100)
    assert len(novel) == len({s.strategy_id for s in novel}) == 100 and all(s.strategy_id.startswith("novel_") for s in novel)
    assert len(strategies.guarded()) == 15 and any("safe_non_degrading" in s.strategy_id for s in strategies.guarded())
    named = strategies.named()
    assert named["safe_non_degrading"].strategy_id == strategies.SAFE_DEFAULT and len(named) == 7 + 15 + 100 + 1
    third = named["novel_03_04"]
    assert (third.temperature, third.overwrite_policy, third.graph_alpha, third.cleanup_mode, third.small_component_superpixels) == (0.75, "disagree_low_pixel_conf", 0.35, "simple", 2)
    assert strategies.resolve(vote_mode="hybrid_conservative", neighbor_ratio=0.7).neighbor_ratio_threshold == 0.7 and strategies.resolve("majority_argmax").aggregate_mode == "majority_argmax"
    assert strategies.generated(0) == [] and [s.strategy_id for s in strategies.generated(6)][-1] == "novel_02_01"
    for wrong in ({"temperature": 0.0}, {"aggregate_mode": "x"}, {"graph_alpha": 1.5}, {"max_change_fraction": 0.0}, {"small_component_superpixels": 0}):
        with pytest.raises(ValueError):
            strategies.validated(strategies.Strategy("x", "t", **wrong))
    with pytest.raises(KeyError):
        strategies.resolve("absent")


def test_low_confidence_and_guard(spark):
    low = strategies.Strategy("t", "t", overwrite_policy="low_pixel_conf", pixel_confidence_threshold=0.6)
    lg = np.array([[[5.0, 0.3, 0.2, 4.0]], [[0.1, 0.4, 4.0, 0.1]]])
    got = strategies.refine(pixels(spark, lg, np.array([[0, 0, 1, 1]])), low)
    assert [r.label for r in got.orderBy("x").collect()] == [0, 0, 1, 0]
    guard = strategies.Strategy("g", "t", overwrite_policy="disagree_low_pixel_conf", pixel_confidence_threshold=0.8, min_superpixel_margin=0.01, max_change_fraction=0.25, max_changed_mean_confidence=0.55)
    lg = np.array([[[4.0, 3.2, 3.0, 2.8]], [[1.2, 2.7, 2.9, 3.1]]])
    got = strategies.refine(pixels(spark, lg, np.array([[0, 0, 0, 0]])), guard).orderBy("x").collect()
    assert [r.label for r in got] == [r.pred for r in got] == lg.argmax(0)[0].tolist()


@pytest.mark.parametrize("name", ["novel_01_04", "novel_09_05", "novel_13_03", "novel_20_05", "safe_confw_p20_t085_safe_non_degrading_v3", "legacy_hybrid_conservative", "legacy_small_region_cleanup", "legacy_majority_argmax"])
def test_whole_strategies_equal_brute_force(spark, name):
    rng = np.random.default_rng(sum(map(ord, name)))
    lg, sp = rng.normal(size=(3, 12, 14)) * 2, rng.integers(0, 3, (4, 5)).repeat(3, 0).repeat(3, 1)[:12, :14]
    sp = sp + 3 * (np.arange(12)[:, None] // 4 * 3 + np.arange(14)[None] // 5)
    sp = np.unique(sp, return_inverse=True)[1].reshape(sp.shape)
    lg += rng.normal(size=(3, sp.max() + 1))[:, sp]
    s, px = strategies.resolve(name), pixels(spark, lg, sp)
    got = np.zeros(sp.shape, int)
    for r in strategies.refine(px, s, quality.adjacency(px)).collect():
        got[r.y, r.x] = r.label
    assert (got == brute(lg, sp, s)).all()


def test_scores_and_labels_are_made_once(spark):
    px = pixels(spark, np.random.default_rng(5).normal(size=(3, 6, 6)), np.arange(36).reshape(6, 6) // 6)
    out = strategies.refine(px, strategies.resolve("novel_09_05"), quality.adjacency(px))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and out.count() == 36  # votes, smoothing and cleanup are read, not made again for the result


def test_compare_uses_every_mode_at_once(spark):
    rng = np.random.default_rng(3)
    px = pixels(spark, rng.normal(size=(3, 9, 9)), np.arange(81).reshape(9, 9) // 9)
    labels = votes.labels_by_mode(votes.confidence(votes.softmax(px)), votes.MODES)
    for mode in votes.MODES:
        one = votes.region_scores(votes.confidence(votes.softmax(px)), mode)
        assert rows(labels, "sp", mode) == rows(one, "sp", "sp_label")
    assert {r["mode"] for r in strategies.compare(px).collect()} == {"baseline", *votes.MODES}


def test_close_open():
    thin = np.zeros((9, 9), int)
    thin[4, 1:8] = 1
    assert close_open(thin).sum() == 7 and (close_open(thin) == thin).all()  # opening leaves nothing: the closed mask stays
    ring = np.ones((9, 9), int)
    ring[4, 4] = 0
    assert close_open(ring)[4, 4] == 1 and close_open(np.zeros((3, 3))).sum() == 0
    rnd = random.Random(1)
    m = np.array([[rnd.random() < 0.6 for _ in range(12)] for _ in range(10)])
    grow = lambda a, f: np.array([[f(a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2], y, x, a.shape) for x in range(a.shape[1])] for y in range(a.shape[0])])
    dilate = lambda a: grow(a, lambda b, *_: b.any())
    erode = lambda a: grow(a, lambda b, y, x, s: b.all() and 0 < y < s[0] - 1 and 0 < x < s[1] - 1)
    want = dilate(erode(erode(dilate(m))))
    assert want.sum() >= 0.2 * m.sum() and (close_open(m) == want).all()
