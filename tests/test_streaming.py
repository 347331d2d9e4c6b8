from tests.conftest import rows
from tessela.streaming.replay import STATE, state_of, stream_state, windowed


def test_stream_equals_batch(spark, tmp_path):
    data = [(r, c, s, float(s * r)) for r in (1, 2) for c in "ab" for s in (3, 1, 2)]
    src = tmp_path / "in"
    for part in (data[:5], data[5:]):
        spark.createDataFrame(part, "run long, cls string, step int, ink double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("run long, cls string, step int, ink double").option("maxFilesPerTrigger", 1).parquet(str(src))
    out: dict = {}

    def upsert(batch, _):
        for r in batch.collect():
            out[r.run, r.cls] = tuple(r)

    q = stream_state(stream).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    batch = spark.createDataFrame(data, "run long, cls string, step int, ink double")
    assert set(out.values()) == rows(state_of(batch), *[c.split()[0] for c in STATE.split(", ")])


def test_windows(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, 'a' AS cls, 1.0D AS ink FROM range(25)")
    assert sorted(r.n for r in windowed(df).collect()) == [5, 10, 10]


def test_events_delivered_again_count_once(spark, tmp_path):
    one = spark.sql("SELECT id AS event_id, 1L AS run, 'a' AS cls, cast(id AS int) AS step, cast(id AS double) AS ink, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts FROM range(5)")
    src = str(tmp_path / "in")
    for df in (one, one.where("event_id > 2"), one.where("event_id < 2")):
        df.coalesce(1).write.mode("append").parquet(src)
    out: dict = {}

    def upsert(batch, _):
        for r in batch.collect():
            out[r.run, r.cls] = tuple(r)

    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_state(stream, "event_id", "ts").writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert out == {(1, "a"): (1, "a", 5, 4.0, 4)}
