"""Live streams give what the batch queries give: fan-out, buffers, heartbeats, job states."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from brindle.streaming import delivery as dv
from brindle.streaming import events as ev

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def live(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    dv.use_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, batches, schema, make, name):
    """All rows of a stream whose batches are files, one after the other."""
    source = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "b=*"))
    out = tmp_path / f"{name}-out"
    query = make(read).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-at"))
    query.trigger(availableNow=True).start().awaitTermination()
    return {tuple(r) for r in spark.read.parquet(str(out)).collect()}


ROWS = "job_id long, ts timestamp, kind string, subscriber string, event string, payload string"


def test_fan_out_without_replay(live, tmp_path):
    batches = [
        [(1, at(0), "event", None, "e0", "before anyone"), (1, at(1), "join", "a", None, None), (1, at(2), "event", None, "e1", "x")],
        [(1, at(3), "join", "b", None, None), (1, at(4), "event", None, "e2", "y"), (2, at(4), "event", None, "f", "nobody")],
        [(1, at(5), "leave", "a", None, None), (1, at(5), "event", None, "e3", "z"), (1, at(6), "event", None, "e4", "w"), (2, at(7), "join", "a", None, None)],
    ]
    got = streamed(live, tmp_path, batches, ROWS, dv.fan_out_stream, "fan")
    rows = live.createDataFrame([r for b in batches for r in b], ROWS)
    events = rows.filter("kind = 'event'").select("job_id", "ts", "event", "payload")
    joins = rows.filter("kind = 'join'").select("job_id", "subscriber", F.col("ts").alias("joined"))
    gone = rows.filter("kind = 'leave'").select("job_id", "subscriber", F.col("ts").alias("gone"))
    batch = dv.fan_out(events, joins.join(gone, ["job_id", "subscriber"], "left"))
    assert got == {tuple(r) for r in batch.collect()}
    assert {(s, e) for _, s, _, e, _ in got} == {("a", "e1"), ("a", "e2"), ("a", "e3"), ("b", "e2"), ("b", "e3"), ("b", "e4")}


def test_buffer_refuses_the_newest(live, tmp_path):
    schema = "job_id long, subscriber string, ts timestamp, kind string, event string, payload string, n int"
    event = lambda k, s: (1, "a", at(k), "event", f"e{k}", s, None)
    batches = [[event(k, "x") for k in range(5)], [(1, "a", at(10), "read", None, None, 2), event(11, "y"), event(12, "y"), event(13, "y")]]
    got = streamed(live, tmp_path, batches, schema, lambda r: dv.buffer_stream(r, ["job_id", "subscriber"], 3), "buffer")
    outcome = {}
    for _, _, o, _, e, _ in got:
        outcome.setdefault(o, set()).add(e)
    assert outcome == {"queued": {"e0", "e1", "e2", "e11", "e12"}, "refused": {"e3", "e4", "e13"}, "sent": {"e0", "e1"}}


def test_buffer_equals_the_batch_query(live, tmp_path):
    rows = live.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("event").alias("kind"),
        F.col("event_id").cast("string").alias("event"), F.lit("").alias("payload"), F.lit(None).cast("int").alias("n"),
    ).orderBy("ts", "event_id")
    listed = [tuple(r) for r in rows.collect()]
    k = len(listed) // 3
    got = streamed(live, tmp_path, [listed[:k], listed[k : 2 * k], listed[2 * k :]], rows.schema, lambda r: dv.buffer_stream(r, ["job_id"], 4), "events")
    want = ev.bounded_buffer(rows.withColumn("id", F.col("event").cast("long")), "job_id", ["ts", "id"], 4)
    assert {e for _, o, _, e, _ in got if o == "queued"} == {r["event"] for r in want.collect()}


def test_heartbeats_equal_the_batch_query(live, tmp_path):
    rows = live.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )
    listed = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[1], r[2]))
    k = len(listed) // 2
    make = lambda r: dv.heartbeat_stream(r.select("job_id", "ts"), 86_400.0, live=False)
    got = streamed(live, tmp_path, [listed[:k], listed[k:]], rows.schema, make, "beats")
    want = ev.heartbeat_gaps(rows, "job_id", "ts", ["event_id"], 86_400.0).select("job_id", "ts", "gap", "beats")
    near = lambda found: sorted((j, t, round(g, 3), b) for j, t, g, b in found)
    assert near(got) == near(tuple(r) for r in want.collect())


def test_heartbeats_while_the_silence_lasts(live, tmp_path):
    source = tmp_path / "live"
    schema = "job_id long, ts timestamp"
    live.createDataFrame([(1, at(0))], schema).write.parquet(str(source))
    stream = dv.heartbeat_stream(live.readStream.schema(schema).parquet(str(source)), 1.0)
    out = stream.writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "at"))
    query = out.trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and live.table("beats").count() < 3:
            time.sleep(0.5)
    finally:
        query.stop()
    got = sorted(tuple(r) for r in live.table("beats").collect())
    assert [(g, b) for _, _, g, b in got][:3] == [(1.0, 1), (2.0, 1), (3.0, 1)]


def test_illegal_steps_equal_the_batch_query(live, tmp_path):
    schema = "job_id long, ts timestamp, status string"
    states = ["pending", "enhancing", "moderating", "enhancing", "completed", "failed", "pending", "odd", "cancelled", "completed"]
    rows = [(1, at(i), s) for i, s in enumerate(states)] + [(2, at(0), "completed"), (2, at(1), "pending"), (2, at(2), "failed")]
    got = streamed(live, tmp_path, [rows[:5], rows[5:]], schema, dv.illegal_steps_stream, "steps")
    want = dv.illegal_steps(live.createDataFrame(rows, schema), ["ts"])
    assert got == {tuple(r) for r in want.collect()}
    assert {(b, a) for _, _, b, a in got} == {
        ("moderating", "enhancing"), ("completed", "failed"), ("pending", "odd"), ("odd", "cancelled"), ("cancelled", "completed"), (None, "completed"),
    } - {("odd", "cancelled")}
