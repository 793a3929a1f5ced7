"""The enhancement chain over frames of mono tracks, by content mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import dsp
from brindle.functions import signal as sg
from brindle.operators import frames as fr
from brindle.staging import stage

#: Loudness of music and of speech, how far a podcast's music is turned down, and the stems' least power that counts.
MUSIC_LUFS, SPEECH_LUFS, BED_DB, BED_RMS = -14.0, -16.0, -12.0, 1e-4


def to_mono(channels: DataFrame, key: str, samples: str = "samples") -> DataFrame:
    """(key, samples): the mean over channels by position, of rows (key, channel, samples)."""
    return fr.from_frames(fr.mixed(fr.to_frames(channels, [key], samples), [key], mean=True), [key])


def music_bed(stems: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, samples): the drums, bass and other stems of (keys, stem, frame, samples), turned down and summed.

    Only tracks whose drums or bass have an RMS above ``BED_RMS`` have a bed.
    """
    square = F.aggregate(F.transform("samples", lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    power = stems.groupBy(*keys, "stem").agg(F.sum(square).alias("s"), F.sum(F.size("samples")).alias("n"))
    loud = power.filter(F.col("stem").isin("drums", "bass") & (F.sqrt(F.col("s") / F.col("n")) > BED_RMS))
    parts = stems.filter(F.col("stem").isin("drums", "bass", "other")).join(loud.select(*keys).distinct(), keys, "left_semi")
    return fr.mixed(parts.withColumn("gain", F.lit(10 ** (BED_DB / 20))), keys)


def with_bed(voice: DataFrame, bed: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of voice and bed summed over their common length; tracks without a bed stay as they are."""
    has = bed.select(*keys).distinct().withColumn("_has", F.lit(True))
    under = bed.select(*keys, "frame", F.col("samples").alias("_bed"))
    rows = voice.join(has, keys, "left").join(under, [*keys, "frame"], "left")
    n = F.least(F.size("samples"), F.coalesce(F.size("_bed"), F.lit(0)))
    summed = F.zip_with(F.slice("samples", 1, n), F.slice("_bed", 1, n), lambda a, b: a + b)
    x = F.when(F.col("_has").isNull(), F.col("samples")).otherwise(F.coalesce(summed, F.slice("samples", 1, 0)))
    return rows.select(*[x.alias("samples") if c == "samples" else F.col(c) for c in voice.columns])


def enhance(
    raw: DataFrame, keys: list[str], rate: int = dsp.RATE, spans: DataFrame | None = None, stems: DataFrame | None = None, size: int = fr.FRAME
) -> tuple[DataFrame, DataFrame]:
    """(frames, report) of frames (keys, frame, samples, mode), where mode is the same in all frames of a track.

    music: loudness and limit only. speech and podcast: suppress what isn't speech, EQ, gate; speech is stripped of its ends,
    a podcast gets its music bed back; then compress, loudness, limit. The report is (keys, mode, snr_db, clipped, lufs,
    quality): SNR is measured before compression, for music before anything. ``spans`` (keys, start, end) come from a speech
    detector, else from the energy; ``stems`` (keys, stem, frame, samples) from a separator. Separation and denoising are
    models, not part of this.
    """
    modes = raw.groupBy(*keys).agg(F.first("mode").alias("mode"))
    music, voice = raw.filter("mode = 'music'"), raw.filter("mode <> 'music'")
    spans = fr.energy_spans(voice, keys, rate) if spans is None else spans
    spans = stage(spans.select(*keys, "start", "end"), "spans")
    quiet = fr.masked(voice.select(*keys, "frame", "samples", "mode"), keys, spans, rate=rate, size=size)
    ends = spans.groupBy(*keys).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    held = quiet.join(ends, keys, "left").withColumns({c: F.when(F.col("mode") == "speech", F.col(c)) for c in ("first", "last")})
    fade = max(1, int(rate * 0.025))
    cleaned = fr.carried(
        held, keys, lambda p: [*dsp.equaliser(rate=rate), dsp.Gate(rate), fr.strip(p["first"], p["last"], fade)], ["first", "last"], size
    )
    if stems is not None:
        podcasts = stems.join(modes.filter("mode = 'podcast'").select(*keys), keys, "left_semi")
        cleaned = with_bed(cleaned, music_bed(podcasts, keys), keys)
    # Voice and music meet in a staged table: Spark takes a union of two branches dealt out by track for one dealt out so
    # itself, and a join with it can then find unequal numbers of partitions.
    voiced = cleaned.withColumn("plain", F.lit(False))
    both = stage(voiced.unionByName(music.select(*keys, "frame", "samples", F.lit(True).alias("plain"))), "cleaned")
    cleaned, plain = (both.filter(c).drop("plain") for c in (~F.col("plain"), F.col("plain")))
    snr = fr.snr(raw, both.drop("plain"), keys)
    pressed = fr.carried(cleaned.join(modes, keys), keys, lambda p: [dsp.Compressor(p["mode"], rate)], ["mode"], size)
    pressed = fr.limited(stage(pressed, "pressed"), keys)
    target = F.when(F.col("mode") == "music", MUSIC_LUFS).otherwise(SPEECH_LUFS)
    levelled = fr.normalised(pressed.unionByName(plain).join(modes, keys), keys, target, rate).select(*keys, "frame", "samples")
    done = stage(fr.limited_true_peak(stage(levelled, "levelled"), keys, rate=rate), "enhanced")
    told = modes.join(snr, keys, "left").join(fr.clipped(raw, keys), keys).join(fr.loudness(done, keys, rate).drop("n"), keys)
    nothing = F.log10(F.lit(1e-10) / F.lit(1e-10)) * 10  # no common prefix: no signal over no difference
    told = told.withColumn("snr_db", F.round(F.coalesce("snr_db", nothing), 2))
    return done, told.withColumn("quality", sg.quality(F.col("snr_db"), F.col("clipped"), F.col("lufs")))
