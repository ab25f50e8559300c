"""Streams with state against their batch versions: late rows, restarts, failures between two steps."""

import json

import pytest
from pyspark.sql import functions as F

from lumenspark.operators.evaluate import latest
from lumenspark.streaming import state

EVENTS = "ts timestamp, user_id long, event_id long, value double"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_latest_equals_batch(spark, tmp_path):
    schema, args = "id string, seq long, v int", [str(tmp_path / x) for x in ("out", "c")]
    batches = [
        [{"id": "a", "seq": 3, "v": 1}, {"id": "b", "seq": 2, "v": 2}, {"id": "a", "seq": 1, "v": 0}],
        [{"id": "a", "seq": 2, "v": 8}, {"id": "b", "seq": 5, "v": 9}, {"id": "c", "seq": 1, "v": 7}],  # a is late
        [{"id": "c", "seq": 1, "v": 6}, {"id": "b", "seq": 4, "v": 3}, {"id": "d", "v": 3}],  # late, late, without order
    ]
    for i, rows in enumerate(batches):
        write(tmp_path / "in", i, rows)
        assert state.keep_latest(spark, str(tmp_path / "in"), schema, *args, "id", "seq") == 1
    log = state.read_committed(spark, args[0], schema)
    assert sorted(tuple(r) for r in log.collect()) == [("a", 3, 1), ("b", 2, 2), ("b", 5, 9), ("c", 1, 7)]
    want = latest(spark.read.schema(schema).json(str(tmp_path / "in")).filter("seq is not null"), "id", "seq")
    key = lambda df: {(r["id"], r["seq"]) for r in df.collect()}
    assert key(latest(log, "id", "seq")) == key(want)
    assert state.keep_latest(spark, str(tmp_path / "in"), schema, *args, "id", "seq") == 0


def test_latest_forgets(spark, tmp_path):
    """With a time to live a key's state goes, so a late row comes through; reading the log by latest() corrects that."""
    import time

    schema, args = "id string, seq long", [str(tmp_path / x) for x in ("out", "c")]
    write(tmp_path / "in", 0, [{"id": "a", "seq": 5}])
    state.keep_latest(spark, str(tmp_path / "in"), schema, *args, "id", "seq", ttl_ms=100)
    time.sleep(0.3)
    write(tmp_path / "in", 1, [{"id": "a", "seq": 4}])
    state.keep_latest(spark, str(tmp_path / "in"), schema, *args, "id", "seq", ttl_ms=100)
    log = state.read_committed(spark, args[0], schema)
    assert sorted(r["seq"] for r in log.collect()) == [4, 5] and latest(log, "id", "seq").first()["seq"] == 5


def rows_at(*minutes, user=1, first=0):
    return [{"ts": f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z", "user_id": user, "event_id": first + i, "value": 1.0} for i, m in enumerate(minutes)]


def run(spark, tmp_path, change, name, schema=EVENTS):
    stream = change(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_sessions_and_late_rows(spark, tmp_path):
    import os
    import time

    parts = [rows_at(0, 10, 50), rows_at(55, 300), rows_at(310), rows_at(15, first=50), rows_at(600)]  # minute 15 comes behind the watermark
    for i, rows in enumerate(parts):
        write(tmp_path / "in", i, rows)
        os.utime(tmp_path / "in" / f"{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    got = run(spark, tmp_path, state.sessions, "sessions_test")
    times = lambda df: sorted(((r["start"].hour * 60 + r["start"].minute), r["n"]) for r in df.collect())
    assert times(got) == [(0, 2), (50, 2), (300, 2)]  # the last one is still open
    batch = state.sessions(spark.read.schema(EVENTS).json(str(tmp_path / "in")))
    assert times(batch) == [(0, 3), (50, 2), (300, 2), (600, 1)]


def test_repeats_within_watermark(spark, tmp_path):
    import os
    import time

    once = rows_at(0, 1, 2)
    parts = [once, [once[1], *rows_at(5, first=9)], [once[2]]]
    for i, rows in enumerate(parts):
        write(tmp_path / "in", i, rows)
        os.utime(tmp_path / "in" / f"{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    got = run(spark, tmp_path, lambda e: state.distinct_within(e, ["event_id"]), "distinct_test")
    assert sorted(r["event_id"] for r in got.collect()) == [0, 1, 2, 9]
    batch = state.distinct_within(spark.read.schema(EVENTS).json(str(tmp_path / "in")), ["event_id"])
    assert sorted(r["event_id"] for r in batch.collect()) == [0, 1, 2, 9] and batch.columns == got.columns


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path, monkeypatch):
    schema, sink, checkpoint = "id long", str(tmp_path / "out"), str(tmp_path / "c")
    write(tmp_path / "in", 0, [{"id": i} for i in range(10)])
    start = lambda **more: state.once(spark.readStream.schema(schema).json(str(tmp_path / "in")), sink, checkpoint, **more)
    ids = lambda: sorted(r["id"] for r in state.read_committed(spark, sink, schema).collect())

    with monkeypatch.context() as m:  # rows are written, the ledger isn't
        m.setattr(state, "commit", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision"):
            start().awaitTermination()
    assert ids() == [] and spark.read.parquet(f"{sink}/batch=*").count() == 10

    def fail(rows, number):
        raise RuntimeError("lost before the query noted the batch")

    with pytest.raises(Exception, match="lost before"):  # both are written, the checkpoint isn't
        start(then=fail).awaitTermination()
    assert ids() == list(range(10))
    calls = []
    start(then=lambda rows, number: calls.append(number)).awaitTermination()
    assert ids() == list(range(10)) and calls == [0] and len(state.committed(spark, sink)) == 1
    write(tmp_path / "in", 1, [{"id": 10}])
    start().awaitTermination()
    assert ids() == list(range(11))
    other = spark.range(3).select("id")
    assert state.add_batch(other, sink, "by-hand") and not state.add_batch(other.filter("id > 9"), sink, "by-hand")
    assert len(ids()) == 14
    assert spark.createDataFrame([], schema).schema == state.read_committed(spark, str(tmp_path / "none"), schema).schema


def test_batch_sessions_match_plain(spark):
    events = spark.createDataFrame([(u, m, 1.0) for u in (1, 2) for m in (0, 29, 59, 60, 200)], "user_id long, m int, value double").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    got = sorted((r["user_id"], r["n"], (r["end"] - r["start"]).seconds // 60) for r in state.sessions(events).collect())
    assert got == sorted((u, n, span) for u in (1, 2) for n, span in ((4, 90), (1, 30)))
