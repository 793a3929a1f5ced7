"""Recordings, settings and audio files as DataFrames."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import csv_list

TRACK = (
    "struct<id: string, name: string, url: string, volume: double, is_muted: boolean, sort_order: int, duration: double, "
    "is_enhanced: boolean, quality_score: double, snr_db: double, transcription: string>"
)
RECORDING = f"id string, title string, tracks array<{TRACK}>"


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings from JSON lines; unknown keys are ignored, malformed lines give null ids."""
    return spark.read.schema(RECORDING).json(path)


def split_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recordings, rejects): JSON lines that are recordings with an id, and (line, reason) of those that aren't.

    Unknown keys are ignored, and values of the wrong type make a line malformed; blank lines are neither.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", RECORDING + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    reason = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed").when(F.col("r.id").isNull(), "no id")
    marked = read.withColumn("reason", reason)
    good = marked.filter("reason is null").select("r.id", "r.title", "r.tracks")
    return good, marked.filter("reason is not null").select(F.col("value").alias("line"), "reason")


def tracks_of(recordings: DataFrame) -> DataFrame:
    """One row per track with defaults filled in, in ``place`` by sort_order and then by position."""
    rows = recordings.select(F.col("id").alias("recording_id"), F.posexplode("tracks").alias("pos", "t"))
    from pyspark.sql import Window

    order = Window.partitionBy("recording_id").orderBy("sort_order", "pos")
    return rows.select(
        "recording_id",
        F.col("t.id").alias("track_id"),
        F.coalesce("t.name", F.lit("")).alias("name"),
        F.col("t.url").alias("url"),
        F.coalesce("t.volume", F.lit(1.0)).alias("volume"),
        F.coalesce("t.is_muted", F.lit(False)).alias("is_muted"),
        F.coalesce("t.sort_order", F.lit(0)).alias("sort_order"),
        F.coalesce("t.duration", F.lit(0.0)).alias("duration"),
        F.coalesce("t.is_enhanced", F.lit(False)).alias("is_enhanced"),
        F.col("t.transcription").isNotNull().alias("has_transcription"),
        F.col("t.quality_score").alias("quality_score"),
        F.col("t.snr_db").alias("snr_db"),
        "pos",
    ).withColumn("place", F.row_number().over(order))


def passthrough_scores(quality: Column, snr: Column) -> tuple[Column, Column]:
    """Scores of a track that was enhanced before: 1.0 and 50.0 where unknown."""
    return F.coalesce(quality, F.lit(1.0)), F.coalesce(snr, F.lit(50.0))


def settings(rows: DataFrame) -> DataFrame:
    """blocked and auto_tags as lists, from the comma-separated settings columns; missing settings are empty lists."""
    return rows.select(
        csv_list(F.col("blocked_keywords")).alias("blocked"), csv_list(F.col("auto_tag_keywords")).alias("auto_tags")
    )


def decode_wav(data: bytes | None) -> tuple[int, list[list[float]]] | None:
    """Rate and channels of 8, 16, 24 or 32 bit PCM audio; None for anything else or nothing."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).T.tolist()


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channel, samples) of WAV files; files that can't be decoded have a null rate and no samples."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = decode_wav(data)
                rows += [(name, None, None, None)] if found is None else [
                    (name, found[0], k, x) for k, x in enumerate(found[1])
                ]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "rate", "channel", "samples"]
            )

    return files.mapInArrow(run, "path string, rate int, channel int, samples array<double>")


def encode_wav(samples: np.ndarray, rate: int = 44_100) -> bytes:
    """16-bit mono PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def settings_of(body: Column, status: Column) -> Column:
    """struct<blocked, auto>: word lists of a platform's answer, JSON text with comma-separated strings.

    Whatever is wrong with it (a code of 300 or more, no JSON, no object, a list that is no string) makes both empty.
    """
    parsed = F.try_parse_json(body)
    kind = lambda name: F.schema_of_variant(F.variant_get(parsed, f"$.{name}", "variant"))
    fields = ("blocked_keywords", "auto_tag_keywords")
    fits = F.coalesce(status < 300, F.lit(False)) & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    for name in fields:
        fits = fits & F.coalesce(kind(name) == "STRING", F.lit(True))
    words = lambda name: csv_list(F.when(fits, F.get_json_object(body, f"$.{name}")))
    return F.struct(*[words(n).alias(a) for n, a in zip(fields, ("blocked", "auto"))])


def sync_platform(platform: DataFrame, blocked: DataFrame) -> DataFrame:
    """The next version of a platform's lexicon (pos, phrase): the blocked words (pos, phrase), or as it was if there are none."""
    some = blocked.limit(1).select(F.lit(True).alias("_some"))
    kept = platform.select("pos", "phrase").join(F.broadcast(some), F.lit(True), "left_anti")
    return kept.unionByName(blocked.select("pos", "phrase"))
