import json
import random

from pyspark.sql import functions as F

from tests.conftest import rows
from tessela.operators.compact import consolidate, state_records

KEYS = ["run_dir", "checkpoint_index", "scribble_id"]
P = "/d/interactive_runs/r/slic/"


def rec(i, **more):
    return json.dumps({"id": i, "points": [[0.1, 0.2]], "params": {"radius": 0.1, "code": 2}} | more)


def files(spark, data):
    return spark.createDataFrame([(p, i, c, "x", 1) for p, i, c in data], "path string, checkpoint_index int, content string, run_dir string, scribble_id int")


def test_contents_and_names(spark):
    data = [
        (P + "state_07.json", 7, rec(1) + "\r\n" + rec(2) + "\n" + rec(3)[:30]), ("/m//interactive_runs/r//slic/state_7.json.bak", None, "﻿[" + rec(4) + "," + rec(5) + "]"),
        (P + "state_8.retry-1.json.gz", None, '{"scribbles":[' + rec(6) + "," + rec(7)[:-3]), (P + "state_last.json", None, rec(8)), (P + "state_9.json", 9, None), (P + "state_9.json", 9, ""),
        (P + "state_9.json", None, '{"scribbles":[{"id":10,"points":[]}]}'), (P + "state_9.json", 9, '{"id":11,"po\n' + rec(12, note="a } { \\\" b")), ("nowhere.json", 1, rec(13)), (None, None, rec(14)),
    ]
    got = rows(state_records(files(spark, data)).select(*KEYS))
    want = {("r/slic", 7, i) for i in (1, 2, 4, 5)} | {("r/slic", 8, 6), ("r/slic", -1, 8), ("r/slic", 9, 10), ("r/slic", 9, 12), ("", 1, 13), (None, -1, 14)}
    assert got == want


def test_records_with_deeply_nested_params(spark):
    def deep(i, levels=3):
        inner = {"id": 99, "s": "} {"}
        for _ in range(levels):
            inner = {"o": inner, "n": 1}
        return rec(i, params=inner)

    data = [
        (P + "state_1.json", 1, deep(1) + "\r\n" + rec(2) + "\n" + deep(3)[:60] + "\n" + deep(4, 400)), (P + "state_2.json", 2, "\ufeff[" + deep(1) + "," + rec(2) + "]"),
        (P + "state_3.json", 3, '{"scribbles":[' + deep(1) + "," + rec(2) + "]}"), (P + "state_4.json", 4, '{"scribbles":[' + deep(1) + "," + deep(2)[:-2]),
        (P + "state_5.json", 5, '{"v":1,"state":{"scribbles":[' + deep(1) + "," + rec(2) + "]}}"), (P + "state_6.json", 6, '{"id":11,"po\n' + deep(1)), (P + "state_7.json", 7, deep(1) + '{"id":2'),
    ]
    got = state_records(files(spark, data)).collect()
    assert {(r.checkpoint_index, r.scribble_id) for r in got} == {(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (5, 1), (5, 2), (6, 1), (7, 1)}
    assert len(got) == 12 and all("params" in json.loads(r.record) for r in got)


def test_very_long_contents(spark):
    text = "\n".join(rec(i) for i in range(5000)) + "\n" + '{"id":9,"points":[' + "[0.1,0.2]," * 200_000
    assert state_records(files(spark, [(P + "state_1.json", 1, text), (P + "state_2.json", 2, '"' * 100_000 + "{" * 10_000)])).count() == 5000


def test_consolidation_keeps_repeats_and_ranges(spark):
    data = [(P + f"state_{i}.json", i, rec(1) + "\n" + rec(2)) for i in range(300)] + [(P + "state_5.json", 5, "\n".join([rec(1)] * 400))]
    records = state_records(files(spark, data))
    path, made = consolidate(records, KEYS, target_bytes=2_000)  # bytes as written, compressed
    back = spark.read.parquet(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))
    files_made = made.collect()
    assert 2 <= len(files_made) < 60 and sum(f.rows for f in files_made) == 1000
    ranges = sorted((tuple(f.least), tuple(f.greatest)) for f in files_made)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_merge_of_runs_is_sorted_rolled_by_bytes_and_keeps_copies(spark):
    rnd = random.Random(8)
    # A hot key holds a third of the rows, copies of one row another tenth, and records differ in size a thousandfold.
    data = [(rnd.choice(["hot", "hot", None, "a", "z", "\u00e9"]), rnd.choice([None, *range(50)]), rnd.randbytes(rnd.choice([10, 10, 100, 5000])).hex(), i) for i in range(12_000)] + [("hot", 1, "same", 0)] * 1200
    df = spark.createDataFrame(data, "k string, n int, body string, i int").repartition(13).withColumn("at", F.timestamp_seconds("i"))
    path, made = consolidate(df, ["k", "n"], target_bytes=400_000)
    back = spark.read.schema(df.schema).parquet(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    order = lambda r: (r.k is not None, (r.k or "").encode(), r.n is not None, r.n or 0)
    files_made = sorted(made.collect(), key=lambda r: r.file)
    assert sum(f.rows for f in files_made) == len(data) and {f.file for f in files_made} == {p.rsplit("/", 1)[1] for p in back.inputFiles()}
    last = None
    for f in files_made:
        keys = [order(r) for r in spark.read.schema(df.schema).parquet(f"{path}/{f.file}").collect()]
        assert keys == sorted(keys) and len(keys) == f.rows and (keys[0], keys[-1]) == (order(f.least), order(f.greatest))
        assert last is None or last <= keys[0]
        last = keys[-1]
    assert sum(0.8 * 400_000 <= f.bytes <= 1.2 * 400_000 for f in files_made) >= 0.9 * len(files_made)


def test_addresses_of_folders():
    from tessela.operators.compact import _file_system

    assert {_file_system(a)[1] for a in ("/a/b", "file:/a/b", "file:///a/b")} == {"/a/b"}


def test_empty(spark):
    path, made = consolidate(state_records(files(spark, [])), KEYS)
    assert made.count() == 0


def test_scratch_is_cleared(spark):
    import os

    from tessela.storage import materialise, shared_dir

    df = materialise(spark.range(3), "x")
    assert df.count() == 3 and df.inputFiles()[0].startswith(shared_dir(spark))
    from tessela.storage import discard, scope

    gone = materialise(spark.range(2), "y")
    discard(gone)
    assert not os.path.exists(gone._scratch.removeprefix("file://"))
    with scope(spark):
        df = materialise(df, "z")
        assert df.count() == 3
    assert not any(n.startswith("tessela-") for n in os.listdir(shared_dir(spark).removeprefix("file://")))
