import math
import random

from pyspark.sql import functions as F

from tessela.llm import percentiles as p

INF, NAN = float("inf"), float("nan")


def check(got, values, error=p.ERROR):
    values = sorted(values)
    for q in p.QUANTILES:
        exact = values[max(1, math.ceil(q * len(values))) - 1]
        value = got[p.column(q)]
        assert value == exact or abs(value - exact) <= error * abs(exact) * (1 + 1e-6), (q, value, exact)


def test_error_bound_and_merging(spark):
    rnd = random.Random(1)
    values = [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-8, 8) for _ in range(1500)] + [0.0] * 200 + [5.0] * 300 + [INF, -INF]
    data = [("g" if i % 3 else "h", i % 7, float(v), "x", 1) for i, v in enumerate(values)] + [("g", 1, NAN, "x", 1), ("h", 1, None, "x", 1)]
    df = spark.createDataFrame(data, "k string, day int, v double, bucket string, n int")
    daily = p.sketch(df.select("k", "day", "v"), ["k", "day"], ["v"])
    for r in p.percentiles(p.merge(daily, ["k"]), ["k"]).collect():
        mine = [x[2] for x in data if x[0] == r.k and x[2] is not None and x[2] == x[2]]
        assert r.n_values == len(mine)
        check(r, mine)
    one = p.percentiles(daily, ["k", "day"]).where("k = 'g' AND day = 1").first()
    check(one, [x[2] for x in data if x[0] == "g" and x[1] == 1 and x[2] is not None and x[2] == x[2]])


def test_very_small_values_and_errors(spark):
    values = [k * 1e-11 for k in range(1, 100)] + [1e250, -1e-250]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    for error in (0.2, p.ERROR, 1e-4, 1e-6):
        check(p.percentiles(p.sketch(df, ["k"], ["v"], error), ["k"], error=error).first(), values, error)
    for error in (0.0, 1e-9, 1.0):
        try:
            p.shift(error)
            assert False
        except ValueError:
            pass


def test_buckets_keep_the_order(spark):
    vs = sorted([-1e9, -3.0, -0.5, -1e-9, 0.0, 1e-310, 1e-9, 0.5, 3.0, 1e9])
    df = spark.createDataFrame([(v,) for v in vs], "v double").select(p.bucket(F.col("v")).alias("b"), p.bucket_value(p.bucket(F.col("v"))).alias("w"), "v")
    got = df.orderBy("v").collect()
    assert [r.b for r in got] == sorted(r.b for r in got)
    assert all(abs(r.w - r.v) <= p.ERROR * abs(r.v) * (1 + 1e-9) + 1e-300 for r in got)


def test_steps_count_once(spark):
    steps = spark.createDataFrame(
        [(1, 1, 0.5, 0.1, "2025-01-01"), (1, 1, 0.5, 0.1, "2025-01-01"), (2, 1, NAN, 0.2, "2025-01-02"), (3, 9, 0.1, 0.1, "2025-01-01"), (None, 1, 0.7, None, None), (None, 1, 0.7, None, None)],
        "metric_id long, case_id long, miou double, coverage double, logged_at string",
    ).withColumn("logged_at", F.to_timestamp("logged_at"))
    cases = spark.createDataFrame([(1, "slic", "x")], "case_id long, method string, day string")
    got = {(r.day and str(r.day), r.metric): r.n for r in p.step_sketch(steps, cases).groupBy("day", "metric").agg(F.sum("n").alias("n")).collect()}
    assert got == {("2025-01-01", "miou"): 1, ("2025-01-01", "coverage"): 1, ("2025-01-02", "coverage"): 1, (None, "miou"): 2}
    assert p.percentiles(p.step_sketch(steps.limit(0), cases), ["method"]).count() == 0
