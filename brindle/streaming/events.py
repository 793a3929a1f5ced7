"""Job events: ordering, bounded buffers, heartbeats and folds, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

BUFFER, HEARTBEAT_SECONDS = 500, 30
TIMEOUT_MS, SEGMENTS = 3_600_000, 100_000
# The events of a job, and those that end it.
EVENTS = (
    "pipeline_started", "recording_fetched", "track_started", "enhancement_started", "enhancement_complete",
    "enhancement_error", "enhancement_skipped", "transcript_segment", "transcript_complete", "transcript_error",
    "transcript_skipped", "categorization_complete", "pipeline_complete", "pipeline_error",
)
FINAL = ("pipeline_complete", "pipeline_error")


def bounded_buffer(events: DataFrame, job: str, order: list[str], size: int = BUFFER) -> DataFrame:
    """The first ``size`` events of each job: when a subscriber's buffer is full, newer events are dropped."""
    place = F.row_number().over(Window.partitionBy(job).orderBy(*order))
    return events.withColumn("place", place.cast("long")).filter(F.col("place") <= size)


def heartbeat_gaps(events: DataFrame, job: str, ts: str, order: list[str], seconds: float = HEARTBEAT_SECONDS) -> DataFrame:
    """Events before which a job was silent for longer, with the gap in seconds and the heartbeats it makes."""
    before = F.lag(ts).over(Window.partitionBy(job).orderBy(ts, *order))
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    gap = (micros(F.col(ts)) - micros(before)) / 1e6
    out = events.withColumn("gap", gap).filter(F.col("gap") > seconds)
    return out.withColumn("beats", F.floor(F.col("gap") / seconds))


def fold_batch(events: DataFrame) -> DataFrame:
    """(job_id, n_segments, transcript, outcome) of jobs with a final event: segment texts before it, in order.

    ``events`` has job_id, event, ts and payload. The batch counterpart of ``fold_stream``.
    """
    ends = events.filter(F.col("event").isin(*FINAL)).groupBy("job_id").agg(F.min(F.struct("ts", "event")).alias("e"))
    parts = events.filter("event = 'transcript_segment'").join(ends, "job_id").filter("ts <= e.ts")
    listed = F.array_sort(F.collect_list(F.struct("ts", "payload")))
    folded = parts.groupBy("job_id").agg(F.count("*").alias("n_segments"), listed.alias("x"))
    text = F.array_join(F.transform("x", lambda s: s["payload"]), " ")
    joined = ends.join(folded.select("job_id", "n_segments", text.alias("transcript")), "job_id", "left")
    return joined.select(
        "job_id",
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        F.coalesce("transcript", F.lit("")).alias("transcript"),
        F.col("e.event").alias("outcome"),
    )


def fold_stream(events: DataFrame, timeout_ms: int | None = TIMEOUT_MS, limit: int = SEGMENTS) -> DataFrame:
    """The same fold over a stream: a job's segments are state until its final event, which emits the row and clears it.

    State is bounded: a job that holds ``limit`` segments emits them as a row with outcome ``partial`` and goes on with
    none, and one that is silent for ``timeout_ms`` emits what it holds with outcome ``expired``. With a timeout the
    stream runs on, as silence has to be waited for: give None where it reads what there is and ends. ``job_id`` keeps
    its type. Rows can be categorised as they come: ``plans.results.text_result`` is a column of the same row.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(parts: list, outcome: str) -> pd.DataFrame:
            texts = [p for _, p in sorted(parts)]
            return pd.DataFrame({"job_id": [key[0]], "n_segments": [len(texts)], "transcript": [" ".join(texts)], "outcome": [outcome]})

        times, texts = state.get if state.exists else ([], [])
        held = list(zip(times, texts))
        if state.hasTimedOut:
            state.remove()
            yield row(held, "expired")
            return
        final = None
        for b in batches:
            for event, ts, payload in zip(b["event"], b["ts"], b["payload"]):
                if event == "transcript_segment":
                    held.append((ts.value if hasattr(ts, "value") else int(ts), payload or ""))
                elif event in FINAL and (final is None or (ts, event) < final):
                    final = (ts, event)
        if final is None and len(held) < limit:
            state.update(([t for t, _ in held], [p for _, p in held]))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
            return
        if state.exists:
            state.remove()
        if final is None:
            yield row(held, "partial")
            return
        last = final[0].value if hasattr(final[0], "value") else int(final[0])
        yield row([(t, p) for t, p in held if t <= last], final[1])

    key = events.schema["job_id"].dataType.simpleString()
    return events.groupBy("job_id").applyInPandasWithState(
        fold,
        f"job_id {key}, n_segments long, transcript string, outcome string",
        "times array<long>, texts array<string>",
        "append",
        "NoTimeout" if timeout_ms is None else "ProcessingTimeTimeout",
    )


def segment_source(tracks: DataFrame) -> DataFrame:
    """(job_id, track_id, seq, kind, text, silent) of transcribed tracks (job_id, track_id, segments, error_class).

    Each track's segment texts in order, then one ``done`` or ``error``; a value error means that nothing was said, which
    is a silent ``done``. A null array has no segments.
    """
    parts = F.coalesce(F.col("segments"), F.array().cast("array<string>"))
    none, fault = F.lit(None).cast("string"), F.col("error_class")
    kind = F.when(fault.isNull() | (fault == "ValueError"), "done").otherwise("error")
    end = F.struct(kind.alias("kind"), none.alias("text"), F.coalesce(fault == "ValueError", F.lit(False)).alias("silent"))
    said = F.transform(parts, lambda x: F.struct(F.lit("segment").alias("kind"), x.alias("text"), F.lit(False).alias("silent")))
    rows = tracks.select("job_id", "track_id", F.posexplode(F.concat(said, F.array(end))).alias("seq", "x"))
    return rows.select("job_id", "track_id", "seq", "x.*")


def event_sequence(jobs: DataFrame, tracks: DataFrame, segments: DataFrame) -> DataFrame:
    """(job_id, place, event, track_id): the events that realtime jobs send, in order.

    ``jobs`` is (job_id, error): one whose recording can't be fetched has an error, and ends at once. ``tracks`` is (job_id,
    track_id, position, is_muted, is_enhanced, has_transcription, enhancement_error); muted ones send nothing, and a failed
    enhancement is an event, not the end of the job. ``segments`` is ``segment_source``. Jobs with a segment are
    categorised. Null flags count as false.
    """
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    alive = jobs.filter("error IS NULL").select("job_id")
    live = tracks.filter(~is_true("is_muted")).join(alive, "job_id", "left_semi")
    step = lambda k, e: F.struct(F.lit(k).alias("step"), F.lit(e).alias("event") if isinstance(e, str) else e.alias("event"))
    ended = F.when(F.col("enhancement_error").isNull(), "enhancement_complete").otherwise("enhancement_error")
    enhanced = F.when(is_true("is_enhanced"), F.array(step(1, "enhancement_skipped")))
    enhanced = enhanced.otherwise(F.array(step(1, "enhancement_started"), step(2, ended)))
    skipped = F.when(is_true("has_transcription"), F.array(step(3, "transcript_skipped")))
    own = F.concat(F.array(step(0, "track_started")), enhanced, F.coalesce(skipped, F.slice(enhanced, 1, 0)))
    of_tracks = live.select("job_id", "track_id", "position", F.explode(own).alias("x"))
    of_tracks = of_tracks.select("job_id", F.lit(1).alias("stage"), "position", "x.step", F.lit(0).alias("seq"), "x.event", "track_id")
    heard = live.filter(~is_true("has_transcription")).select("job_id", "track_id", "position")
    name = F.when(F.col("kind") == "segment", "transcript_segment").when(F.col("kind") == "done", "transcript_complete")
    of_segments = segments.join(heard, ["job_id", "track_id"]).select(
        "job_id", F.lit(1).alias("stage"), "position", F.lit(3).alias("step"), "seq",
        name.otherwise("transcript_error").alias("event"), "track_id",
    )
    spoken = of_segments.filter("event = 'transcript_segment'").select("job_id", F.lit(True).alias("spoken")).distinct()
    frame = lambda stage, seq, e: F.struct(F.lit(stage).alias("stage"), F.lit(seq).alias("seq"), F.lit(e).alias("event"))
    start, close = frame(0, 0, "pipeline_started"), frame(2, 1, "pipeline_complete")
    whole = F.array(start, frame(0, 1, "recording_fetched"), close)
    talked = F.array(start, frame(0, 1, "recording_fetched"), frame(2, 0, "categorization_complete"), close)
    listed = F.when(F.col("error").isNotNull(), F.array(start, frame(2, 1, "pipeline_error"))).when(F.col("spoken"), talked)
    of_jobs = jobs.join(spoken, "job_id", "left").select("job_id", F.explode(listed.otherwise(whole)).alias("x"))
    nothing = F.lit(None)
    of_jobs = of_jobs.select(
        "job_id", "x.stage", nothing.cast("int").alias("position"), F.lit(0).alias("step"), "x.seq", "x.event",
        nothing.cast("string").alias("track_id"),
    )
    rows = of_jobs.unionByName(of_tracks).unionByName(of_segments)
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("stage", "position", "track_id", "step", "seq"))
    return rows.select("job_id", place.cast("long").alias("place"), "event", "track_id")


def track_failures(tracks: DataFrame, realtime: bool) -> DataFrame:
    """(job_id, n_tracks, n_failed, outcome): failed enhancements of tracks (job_id, is_muted, is_enhanced, enhancement_error).

    A realtime job goes on with the raw audio; in a batch job one failed track fails the job.
    """
    failed = F.col("enhancement_error").isNotNull() & ~F.coalesce("is_enhanced", F.lit(False))
    rows = tracks.filter(~F.coalesce("is_muted", F.lit(False)))
    out = rows.groupBy("job_id").agg(F.count("*").alias("n_tracks"), F.count_if(failed).alias("n_failed"))
    bad = F.lit(not realtime) & (F.col("n_failed") > 0)
    return out.withColumn("outcome", F.when(bad, "failed").otherwise("completed"))
