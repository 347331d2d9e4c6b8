import random

from tests.conftest import rows
from tessela.llm import topn
from tessela.llm.names import case_groups, method_name
from pyspark.sql import functions as F

STEP = "metric_id long, case_id long, step int, coverage double, miou double, ingested_at long, method string, label string, gid int, a int, bound int"
CASE = "case_id long, method string, label string, created_at long, miou double"
NAN = float("nan")


def steps(spark, data):
    return spark.createDataFrame([(*r, i, "x", "y", 1, 2, 3) for i, r in enumerate(data)], STEP)


def cases(spark, data):
    return case_groups(spark.createDataFrame([(*r, 0.0) for r in data], CASE))


def brute(data, groups, n):
    best: dict = {}
    for m, c, s, cov, miou in set(map(lambda r: tuple(None if x != x else x for x in r), data)):
        if miou is None or c not in groups:
            continue
        key = (-miou, cov is None, -(cov or 0), s is None, s or 0, m is None, m or 0)
        best.setdefault(groups[c], []).append((key, m))
    return {(*g, m) for g, x in best.items() for _, m in sorted(x)[:n]}


def test_names(spark):
    raw = [" FWB ", "\tws\n", "SLIC ", "Deep_SLIC", None, " ", "　fwbx", "\x1fsin"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, m string")
    assert [r.m for r in df.select("i", method_name(F.col("m")).alias("m")).orderBy("i").collect()] == ["felzenszwalb", "watershed", "slic", "deep_slic", None, "", "fwbx", "sin"]


def test_ties_repeats_and_nulls(spark):
    data = [(i, 1, 0, 0.5, 0.5) for i in range(9)] + [(20, 1, 1, NAN, 0.5), (21, 1, 0, None, 0.5), (22, 1, None, 0.9, 0.9), (23, 1, 0, 0.1, NAN), (24, 1, 0, 0.1, None), (25, 7, 0, 1.0, 1.0), (None, 1, 0, 0.5, 0.9)]
    data += [data[0], data[11], (30, 2, 0, 0.1, 0.4), (31, 3, 0, -0.1, -0.4), (32, None, 0, 0.1, 0.9)]
    known = cases(spark, [(1, " WS", "l", 1), (1, "slic", "l", 0), (2, "watershed", "l", 1), (3, None, None, 1), (None, "x", "y", 1)])
    groups = {1: ("watershed", "l"), 2: ("watershed", "l"), 3: (None, None)}
    for n in (1, 3, 5, 20):
        assert rows(topn.top_n(steps(spark, data), known, n), "method", "label", "metric_id") == brute(data, groups, n)


def test_hot_group_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(topn, "_COMPACT_ROWS", 50)
    rnd = random.Random(5)
    data = [(i // 2, (i // 2) % 40 if (i // 2) % 3 else 0, (i // 2) % 9, ((i // 2) * 7 % 11) / 10, ((i // 2) * 13 % 17) / 16) for i in rnd.sample(range(3000), 3000)]
    known = cases(spark, [(c, "slic", f"l{c % 5}", 1) for c in range(40)])
    df = steps(spark, data).repartition(6)
    got = topn.top_n(df, known, 5)
    assert rows(got, "method", "label", "metric_id") == brute(data, {c: ("slic", f"l{c % 5}") for c in range(40)}, 5)


def test_empty(spark):
    assert topn.top_n(steps(spark, []), cases(spark, [(1, "a", "b", 1)]), 5).count() == 0
    assert topn.top_n(steps(spark, [(1, 1, 1, 1.0, 1.0)]), cases(spark, []), 5).count() == 0
