"""Recordings of several tracks: mixing, speech intervals, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.signal import CEILING, peak
from brindle.operators import frames


def mix_tracks(tracks: DataFrame, recording: str, samples: str = "samples", gain: str = "gain") -> DataFrame:
    """(recording, samples): the tracks' sum by position, padded to the longest, scaled so that no peak passes 0.99.

    Frames of 65,536 samples are summed in their places, so a recording of any length or number of tracks is spread over
    tasks and pre-aggregated; only the finished mix is put together again. ``operators.frames`` mixes without that.
    """
    rows = frames.to_frames(tracks.select(recording, F.col(gain).alias("gain"), samples), [recording, "gain"], samples)
    mix = frames.from_frames(frames.mixed(rows, [recording]), [recording])
    top = peak(F.col("samples"))
    scale = F.when(top > CEILING, F.lit(CEILING) / top).otherwise(F.lit(1.0))
    return mix.select(recording, F.transform("samples", lambda v: v * scale).alias("samples"))


def speech_intervals(
    spans: DataFrame, track: str, total: str, rate: int = 44_100, vad_rate: int = 16_000, least_ms: int = 100, pad_ms: int = 120
) -> DataFrame:
    """(track, start, end) in samples at ``rate`` of spans (track, start, end at vad_rate, total samples at rate).

    Spans shorter than ``least_ms`` go; the others are padded, held to the track, and scaled.
    """
    scale = rate / vad_rate
    pad, least = vad_rate * pad_ms // 1000, vad_rate * least_ms // 1000
    longest = F.floor(F.col(total) / scale)
    kept = spans.filter(F.col("end") - F.col("start") >= least)
    a = F.greatest(F.lit(0), F.col("start") - pad)
    b = F.least(longest, F.col("end") + pad)
    begin = F.least(F.round(a * scale).cast("long"), F.col(total) - 1)
    stop = F.least(F.round(b * scale).cast("long"), F.col(total))
    return kept.select(track, begin.alias("start"), stop.alias("end")).filter(F.col("end") > F.col("start"))


def merged_intervals(intervals: DataFrame, track: str) -> DataFrame:
    """(track, start, end): overlapping or touching intervals as one."""
    order = Window.partitionBy(track).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1)), 1).otherwise(0)
    numbered = intervals.withColumn("fresh", fresh)
    numbered = numbered.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(track, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def processing_summary(tracks: DataFrame, recording: str) -> DataFrame:
    """Tracks in all, active, enhanced, and with a transcript, of each recording."""
    return tracks.groupBy(recording).agg(
        F.count("*").alias("n_tracks"),
        F.count_if(~F.col("is_muted")).alias("n_active"),
        F.count_if(F.col("is_enhanced")).alias("n_enhanced"),
        F.count_if(F.col("has_transcription")).alias("n_transcribed"),
    )


def untranscribed(tracks: DataFrame, transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """Active tracks that have no transcript (keys, text) with something in it: those that are still to be transcribed."""
    there = transcripts.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(*keys).distinct()
    return tracks.filter(~F.coalesce("is_muted", F.lit(False))).join(there, keys, "left_anti")
