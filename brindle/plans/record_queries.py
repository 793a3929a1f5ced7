"""Queries over signals, transcripts, jobs and events; each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import dsp
from brindle.functions import signal as sg
from brindle.operators import frames, jobs, outbox, tracks, transcripts
from brindle.sources import versions
from brindle.staging import scratch, table
from brindle.streaming import delivery
from brindle.streaming import events as ev

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- signals: an embedding is a track's samples, four tracks are a recording


def waves(spark, sf_dir, gain: float = 1.0) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").repartition("vec_id")
    samples = F.transform(sg.doubles(F.col("embedding")), lambda v: v * gain)
    return rows.select("vec_id", F.floor(F.col("vec_id") / 4).alias("rec_id"), samples.alias("samples"))


def _waves(gain: float = 1.0) -> str:
    return (
        f"(SELECT vec_id, vec_id // 4 AS rec_id, list_transform(embedding, lambda v: v::DOUBLE * {gain}::DOUBLE) AS x "
        "FROM embeddings)"
    )


_PEAK = "list_max(list_transform(x, lambda v: abs(v)))"


@query(f"""
WITH p AS (SELECT rec_id, unnest(x) * (1 + vec_id % 3) AS v, generate_subscripts(x, 1) AS pos FROM {_waves()}),
s AS (SELECT rec_id, pos, sum(v) AS v FROM p GROUP BY ALL),
m AS (SELECT rec_id, count(*) AS n, max(abs(v)) AS peak, sum(abs(v)) AS total FROM s GROUP BY rec_id)
SELECT rec_id, n, round(least(peak, 0.99)::DOUBLE, 6) AS peak,
  round(total * CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1 END, 6) AS total FROM m""")
def mix_tracks(spark, sf_dir):
    rows = waves(spark, sf_dir).withColumn("gain", (1 + F.col("vec_id") % 3).cast("double"))
    out = tracks.mix_tracks(rows, "rec_id")
    size = sg.total(F.transform("samples", lambda v: F.abs(v)))
    return out.select(
        "rec_id",
        F.size("samples").cast("long").alias("n"),
        F.round(sg.peak(F.col("samples")), 6).alias("peak"),
        F.round(size, 6).alias("total"),
    )


@query(f"""
SELECT vec_id, round({_PEAK}, 6) AS peak, round(sqrt(list_avg(list_transform(x, lambda v: v * v))), 6) AS rms,
  round(list_avg(list_transform(x, lambda v: CASE WHEN abs(v) > 0.99 THEN 1.0 ELSE 0.0 END))::DOUBLE, 6) AS clip,
  list_avg(list_transform(x, lambda v: CASE WHEN abs(v) > 0.99 THEN 1.0 ELSE 0.0 END)) > 0.001 AS clipped
FROM {_waves(3.0)}""")
def peak_rms_clip(spark, sf_dir):
    x = F.col("samples")
    return waves(spark, sf_dir, 3.0).select(
        "vec_id",
        F.round(sg.peak(x), 6).alias("peak"),
        F.round(sg.rms(x), 6).alias("rms"),
        F.round(sg.clip_share(x), 6).alias("clip"),
        sg.clipped(x).alias("clipped"),
    )


_SNR = """10 * log10(greatest(list_avg(list_transform(e, lambda v: v * v)), 1e-10)
  / (list_avg(list_transform(list_zip(r, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + 1e-10))"""


@query(f"""
WITH p AS (SELECT vec_id, x AS r, list_transform(x, lambda v: v * 0.9::DOUBLE) AS e,
  list_max(x) > 0.3 AS clips, -30.0 + vec_id % 25 AS lufs FROM {_waves()}),
s AS (SELECT *, {_SNR} AS snr FROM p)
SELECT vec_id, round(snr, 6) AS snr, round(greatest(0.0, least(1.0, greatest(0.0, (snr + 5) / 40)) * 0.6
  + (1.0 - least(1.0, abs(lufs + 16.0) / 20)) * 0.4 - CASE WHEN clips THEN 0.3 ELSE 0.0 END)::DOUBLE, 3) AS quality
FROM s""")
def snr_quality(spark, sf_dir):
    rows = waves(spark, sf_dir)
    rows = rows.withColumn("snr", sg.snr_db(F.col("samples"), F.transform("samples", lambda v: v * 0.9)))
    lufs = F.lit(-30.0) + F.col("vec_id") % 25
    quality = sg.quality(F.col("snr"), F.array_max("samples") > 0.3, lufs)
    return rows.select("vec_id", F.round("snr", 6).alias("snr"), quality.alias("quality"))


@query("""
SELECT vec_id, CASE WHEN v < 1e-5 THEN 'music' WHEN (d + b) / (d + b + o + v + 1e-10) > 0.4
    AND v / (d + b + o + v + 1e-10) < 0.2 THEN 'music'
  WHEN v / (d + b + o + v + 1e-10) > 0.3 AND (d + b + o) / (d + b + o + v + 1e-10) > 0.15 THEN 'podcast' ELSE 'speech' END AS mode
FROM (SELECT vec_id, vec_id % 7 / 10::DOUBLE AS d, vec_id % 3 / 10::DOUBLE AS b, vec_id % 5 / 10::DOUBLE AS o,
  vec_id % 11 / 10::DOUBLE AS v FROM embeddings)""")
def mode_detect(spark, sf_dir):
    part = lambda m: (F.col("vec_id") % m) / F.lit(10.0)
    mode = sg.content_mode(part(7), part(3), part(5), part(11))
    return table(spark, sf_dir, "embeddings").select("vec_id", mode.alias("mode"))


@query(f"""
SELECT vec_id, round(list_reduce(list_prepend(0::DOUBLE, list_transform(x, lambda v: abs(v))),
  lambda p, v: CASE WHEN v > p THEN 0.9 * p + (1 - 0.9) * v ELSE 0.99 * p + (1 - 0.99) * v END), 6) AS level
FROM {_waves()}""")
def envelope_final(spark, sf_dir):
    level = sg.envelope_end(F.transform("samples", lambda v: F.abs(v)), 0.9, 0.99)
    return waves(spark, sf_dir).select("vec_id", F.round(level, 6).alias("level"))


@query(f"""
SELECT vec_id, round(x[1] * g, 6) AS first, round(x[len(x)] * g, 6) AS last
FROM (SELECT *, CASE WHEN {_PEAK} < 1e-8 THEN 1 ELSE pow(10, -1 / 20::DOUBLE) / {_PEAK} END AS g FROM {_waves()})""")
def peak_normalise(spark, sf_dir):
    rows = waves(spark, sf_dir).withColumn("y", sg.peak_normalise(F.col("samples")))
    first, last = F.get("y", F.lit(0)), F.element_at("y", -1)
    return rows.select("vec_id", F.round(first, 6).alias("first"), F.round(last, 6).alias("last"))


@query(f"""
WITH v AS (SELECT vec_id, list_filter(list_transform(x, lambda y: 120 + y * 400), lambda f: f > 50) AS f FROM {_waves()}),
s AS (SELECT *, len(f) AS n, list_avg(f) AS m, list_sort(f)[(len(f) - 1) // 2 + 1] AS med,
  CASE WHEN len(f) > 10 THEN list_avg(f[(len(f) * 0.7)::DOUBLE::INT - CASE WHEN (len(f) * 0.7)::DOUBLE::INT > len(f) * 0.7 THEN 1 ELSE 0 END + 1:])
    / (list_avg(f[1:floor(len(f) * 0.3)::INT]) + 1e-8) ELSE 1.0 END AS rise,
  sqrt(list_sum(list_transform(f, lambda y: (y - list_avg(f)) * (y - list_avg(f)))) / (len(f) - 1)) AS sd,
  list_max(f) - list_min(f) AS wide FROM v)
SELECT vec_id, CASE WHEN vec_id % 10 = 0 OR n < 5 THEN 'male_us' ELSE
  CASE WHEN med >= 165 THEN 'female' ELSE 'male' END || '_' ||
  CASE WHEN rise > 1.08 THEN 'au' WHEN sd / (m + 1e-8) > 0.25 OR wide > 120 THEN 'uk' ELSE 'us' END END AS voice FROM s""")
def voice_decision(spark, sf_dir):
    f0 = F.transform("samples", lambda v: 120 + v * 400)
    seconds = F.when(F.col("vec_id") % 10 == 0, 0.05).otherwise(1.0)
    return waves(spark, sf_dir).select("vec_id", sg.voice(f0, seconds).alias("voice"))


@query("""
WITH s AS (SELECT user_id AS track, (event_id * 977) % 400000 AS a, (event_id * 977) % 400000 + (event_id * 31) % 9000 AS b,
  1100000 AS total FROM events),
k AS (SELECT track, total, greatest(0, a - 1920) AS a, least(floor(total / (44100 / 16000::DOUBLE))::BIGINT, b + 1920) AS b
  FROM s WHERE b - a >= 1600),
i AS (SELECT track, least(round(a * (44100 / 16000::DOUBLE))::BIGINT, total - 1) AS s,
  least(round(b * (44100 / 16000::DOUBLE))::BIGINT, total) AS e FROM k),
f AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY track ORDER BY s, e
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM i WHERE e > s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM f)
SELECT track, min(s)::BIGINT AS "start", max(e)::BIGINT AS "end" FROM g GROUP BY track, part""")
def vad_intervals(spark, sf_dir):
    begin = (F.col("event_id") * 977) % 400000
    spans = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"),
        begin.alias("start"),
        (begin + (F.col("event_id") * 31) % 9000).alias("end"),
        F.lit(1_100_000).cast("long").alias("total"),
    )
    return tracks.merged_intervals(tracks.speech_intervals(spans, "track", "total"), "track")


@query(f"""
SELECT vec_id, least(len(x), 20 + vec_id % 60)::BIGINT AS n, round(list_sum(x[1:20 + vec_id % 60]), 6) AS total FROM {_waves()}""")
def match_length(spark, sf_dir):
    other = F.sequence(F.lit(1), (20 + F.col("vec_id") % 60).cast("int"))
    a, b = sg.match_length(F.col("samples"), other)
    return waves(spark, sf_dir).select(
        "vec_id", F.size(b).cast("long").alias("n"), F.round(sg.total(a), 6).alias("total")
    )


FRAME = 24  # samples of a frame here: tables' signals are short, and are to have several


def wave_frames(spark, sf_dir) -> DataFrame:
    return frames.to_frames(waves(spark, sf_dir), ["vec_id"], size=FRAME)


def _wave_report(rows: DataFrame) -> DataFrame:
    """(vec_id, n, peak, rms) of frames."""
    square = F.aggregate(F.transform("samples", lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    top = F.coalesce(F.array_max(F.transform("samples", lambda v: F.abs(v))), F.lit(0.0))
    met = rows.groupBy("vec_id").agg(F.sum(F.size("samples")).alias("n"), F.max(top).alias("peak"), F.sum(square).alias("s"))
    rms = F.when(F.col("n") > 0, F.sqrt(F.col("s") / F.col("n"))).otherwise(0.0)
    return met.select("vec_id", F.col("n").cast("long"), F.round("peak", 6).alias("peak"), F.round(rms, 6).alias("rms"))


def _coefficient(ms: float, rate: int) -> str:
    return f"{dsp.constant(ms, rate)!r}::DOUBLE"


def _recursion(start: str, step: str, columns: str, then: str) -> str:
    """SQL that steps through each signal's samples: ``start`` and ``step`` are the state's columns before the first sample
    and after ``x[i]``; ``then`` selects from the steps ``r``."""
    return f"""
WITH RECURSIVE s AS (SELECT vec_id, x, len(x) AS total FROM {_waves()}),
r AS (SELECT vec_id, 0 AS i, {start} FROM s
  UNION ALL SELECT vec_id, i, {columns} FROM ({step})) {then}"""


_REPORT = """SELECT vec_id, count(*) AS n, round(max(abs(y)), 6) AS peak, round(sqrt(avg(y * y)), 6) AS rms
FROM r WHERE i > 0 GROUP BY vec_id"""
_NEXT = "SELECT r.*, i + 1 AS k, x[i + 1] AS v FROM r JOIN s USING (vec_id) WHERE i < total"


def _gate_sql(rate: int, threshold_db: float) -> str:
    rise, fall = _coefficient(1, rate), _coefficient(150, rate)
    follow = lambda p, v: f"CASE WHEN {v} > {p} THEN {rise} * {p} + (1 - {rise}) * {v} ELSE {fall} * {p} + (1 - {fall}) * {v} END"
    step = f"""SELECT vec_id, k AS i, e, c, {follow("g", "h")} AS g, v FROM (
      SELECT *, CASE WHEN c <= {int(rate * 0.05)} THEN 1::DOUBLE ELSE 0::DOUBLE END AS h FROM (
        SELECT vec_id, k, v, g, e2 AS e, CASE WHEN e2 > pow(10, {threshold_db} / 20::DOUBLE) THEN 0 ELSE c + 1 END AS c FROM (
          SELECT *, {follow("e", "abs(v)")} AS e2 FROM ({_NEXT}))))"""
    start = "0::DOUBLE AS e, 1000000 AS c, 1::DOUBLE AS g, 0::DOUBLE AS y"
    return _recursion(start, step, "e, c, g, v * g AS y", _REPORT)


@query(_gate_sql(1000, -12.0))
def noise_gate(spark, sf_dir):
    out = frames.carried(wave_frames(spark, sf_dir), ["vec_id"], lambda p: [dsp.Gate(1000, -12.0)], size=FRAME)
    return _wave_report(out)


def _compressor_sql() -> str:
    threshold_db, ratio, makeup_db, attack, release = dsp.COMPRESSOR["speech"]
    rise, fall = _coefficient(attack, dsp.RATE), _coefficient(release, dsp.RATE)
    t = f"pow(10, {threshold_db} / 20::DOUBLE)"
    step = f"""SELECT vec_id, k AS i, e, {fall} * g + (1 - {fall}) * h AS g, v FROM (
      SELECT *, CASE WHEN e > {t} THEN ({t} + (e - {t}) / {ratio}::DOUBLE) / (e + 1e-12) ELSE 1::DOUBLE END AS h FROM (
        SELECT vec_id, k, v, g, CASE WHEN abs(v) > e THEN {rise} * e + (1 - {rise}) * abs(v)
          ELSE {fall} * e + (1 - {fall}) * abs(v) END AS e FROM ({_NEXT})))"""
    loud = f"v * greatest(0, least(1, g)) * pow(10, {makeup_db} / 20::DOUBLE) AS y"
    return _recursion("0::DOUBLE AS e, 0::DOUBLE AS g, 0::DOUBLE AS y", step, f"e, g, {loud}", _REPORT)


@query(_compressor_sql())
def compressor(spark, sf_dir):
    out = frames.carried(wave_frames(spark, sf_dir), ["vec_id"], lambda p: [dsp.Compressor()], size=FRAME)
    return _wave_report(frames.limited(out, ["vec_id"]))


def _sections_sql(sections: list, hold: bool, then: str, source: str = "") -> str:
    """Second-order sections one after the other, as recursion over their states."""
    step, carried = _NEXT, []
    for n, (b, a) in enumerate(sections):
        own = [f"p{n}", f"q{n}"]
        b, a = ([f"{v / a[0]!r}::DOUBLE" for v in c] for c in (b, a))
        y = f"{b[0]} * v + {own[0]}"
        step = f"""SELECT * EXCLUDE ({own[0]}, {own[1]}, v, y{n}), {b[1]} * v - {a[1]} * y{n} + {own[1]} AS {own[0]},
          {b[2]} * v - {a[2]} * y{n} AS {own[1]}, {f"greatest(-1, least(1, y{n}))" if hold else f"y{n}"} AS v
          FROM (SELECT *, {y} AS y{n} FROM ({step}))"""
        carried += own
    listed = ", ".join(carried)
    step = f"SELECT vec_id, k AS i, {listed}, v FROM ({step})"
    start = ", ".join(f"0::DOUBLE AS {c}" for c in carried) + ", 0::DOUBLE AS y"
    out = _recursion(start, step, f"{listed}, v AS y", then)
    return out.replace(_waves(), source) if source else out


def _peaking(kind: str, frequency: float, gain_db: float, q: float, rate: int) -> tuple[tuple, tuple]:
    """A band's coefficients, by the cookbook's formulas."""
    w = 2 * math.pi * frequency / rate
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    if kind == "peak":
        a = 10 ** (gain_db / 40)
        return (1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)
    s = 1 + c if kind == "high" else 1 - c
    return (s / 2, -s if kind == "high" else s, s / 2), (1 + alpha, -2 * c, 1 - alpha)


@query(_sections_sql([_peaking(*band, dsp.RATE) for band in dsp.SPEECH_EQ], True, _REPORT))
def eq_speech(spark, sf_dir):
    return _wave_report(frames.carried(wave_frames(spark, sf_dir), ["vec_id"], lambda p: dsp.equaliser(), size=FRAME))


@query(_sections_sql([_peaking(*band, dsp.RATE) for band in dsp.MUSIC_EQ], True, _REPORT))
def eq_music(spark, sf_dir):
    return _wave_report(frames.carried(wave_frames(spark, sf_dir), ["vec_id"], lambda p: dsp.equaliser(dsp.MUSIC_EQ), size=FRAME))


LOUD_RATE, LOUD_TIMES = 4_000, 40


def _k_sections(rate: int) -> list[tuple[list, list]]:
    w = 2 * math.pi * 1500.0 / rate
    amp, c = 10 ** (4.0 / 40), math.cos(w)
    r = 2 * math.sqrt(amp) * math.sin(w) / (2 / math.sqrt(2))
    b = [amp * (amp + 1 + (amp - 1) * c + r), -2 * amp * (amp - 1 + (amp + 1) * c), amp * (amp + 1 + (amp - 1) * c - r)]
    a = [amp + 1 - (amp - 1) * c + r, 2 * (amp - 1 - (amp + 1) * c), amp + 1 - (amp - 1) * c - r]
    w = 2 * math.pi * 38.0 / rate
    c, alpha = math.cos(w), math.sin(w)
    return [(b, a), ([(1 + c) / 2, -(1 + c), (1 + c) / 2], [1 + alpha, -2 * c, 1 - alpha])]


_LEVEL = "-0.691 + 10 * log10(greatest({}, 1e-30))"
_GATED = f"""SELECT vec_id, round(coalesce(-0.691 + 10 * log10(avg(p) FILTER (l > g)), -99), 4)::DOUBLE AS lufs FROM (
  SELECT vec_id, p, CASE WHEN l >= -70 THEN l END AS l,
    -0.691 + 10 * log10(avg(p) FILTER (l >= -70) OVER (PARTITION BY vec_id)) - 10 AS g
  FROM (SELECT vec_id, p, {_LEVEL.format("p")} AS l FROM ({{}}))) GROUP BY vec_id"""


@query(_sections_sql(
    _k_sections(LOUD_RATE), False,
    ", h AS (SELECT vec_id, (i - 1) // 400 AS hop, sum(y * y) AS s, count(*) AS n FROM r WHERE i > 0 GROUP BY ALL), "
    "b AS (SELECT vec_id, sum(s) OVER w / 1600 AS p, count(*) OVER w AS c FROM h WHERE n = 400 "
    "WINDOW w AS (PARTITION BY vec_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) "
    + _GATED.format("SELECT vec_id, p FROM b WHERE c = 4"),
    f"(SELECT vec_id, list_transform(generate_series(0, {64 * LOUD_TIMES - 1}), lambda i: embedding[i % 64 + 1]::DOUBLE "
    "* CASE WHEN i >= 1500 THEN 0.01 ELSE 1 END) AS x FROM embeddings)",
))
def lufs(spark, sf_dir):
    """Loudness of signals repeated to 2,560 samples, of which the last are quiet: blocks fall to the gate."""
    longer = F.flatten(F.array_repeat("samples", LOUD_TIMES))
    quiet = F.transform(longer, lambda v, i: F.when(i >= 1500, v * 0.01).otherwise(v))
    rows = frames.to_frames(waves(spark, sf_dir).select("vec_id", quiet.alias("samples")), ["vec_id"], size=700)
    return frames.loudness(rows, ["vec_id"], LOUD_RATE).select("vec_id", F.round("lufs", 4).alias("lufs"))


@query(_GATED.format(f"SELECT vec_id, abs(unnest(x)) * pow(10, -(vec_id % 5)) AS p FROM {_waves()}"))
def loudness_gates(spark, sf_dir):
    """The two gates over block powers, for which the samples stand."""
    power = F.abs(F.col("v")) * F.pow(F.lit(10.0), -(F.col("vec_id") % 5))
    rows = waves(spark, sf_dir).select("vec_id", F.explode("samples").alias("v")).select("vec_id", power.alias("power"))
    return frames.gated_loudness(rows, ["vec_id"]).select("vec_id", F.round("lufs", 4).alias("lufs"))


_SINC = "CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END"


@query(f"""
WITH s AS (SELECT vec_id, x, unnest(generate_series(0, 4 * len(x) - 1)) AS j FROM {_waves()}),
k AS (SELECT vec_id, j, x[a + 1] AS v, (a - j / 4::DOUBLE) * 0.99 AS t
  FROM (SELECT vec_id, x, j, unnest(generate_series(greatest(0, j // 4 - 7), least(len(x) - 1, j // 4 + 8))) AS a FROM s)),
y AS (SELECT vec_id, j, sum(CASE WHEN abs(t) < 6 THEN v * {_SINC} * pow(cos(pi() * t / 12), 2) * 0.99 ELSE 0 END) AS y FROM k GROUP BY ALL)
SELECT vec_id, round(max(abs(y)), 6) AS true_peak FROM y GROUP BY vec_id""")
def true_peak(spark, sf_dir):
    out = frames.true_peaks(wave_frames(spark, sf_dir), ["vec_id"])
    return out.select("vec_id", F.round("peak", 6).alias("true_peak"))


@query(f"""
WITH s AS (SELECT vec_id, x, unnest(generate_series(0, ceil(len(x) * 3 / 2::DOUBLE)::BIGINT - 1)) AS j FROM {_waves()}),
k AS (SELECT vec_id, j, x[a + 1] AS v, (a - j * 2 / 3::DOUBLE) * 0.99 AS t
  FROM (SELECT vec_id, x, j, unnest(generate_series(greatest(0, j * 2 // 3 - 7), least(len(x) - 1, j * 2 // 3 + 8))) AS a FROM s)),
y AS (SELECT vec_id, j, sum(CASE WHEN abs(t) < 6 THEN v * {_SINC} * pow(cos(pi() * t / 12), 2) * 0.99 ELSE 0 END) AS y FROM k GROUP BY ALL)
SELECT vec_id, count(*) AS n, round(max(abs(y)), 6) AS peak, round(sqrt(avg(y * y)), 6) AS rms FROM y GROUP BY vec_id""")
def resample_signal(spark, sf_dir):
    out = frames.carried(wave_frames(spark, sf_dir), ["vec_id"], lambda p: [dsp.Resampler(400, 600)], size=FRAME)
    return _wave_report(out)


_RISE = "(1 - cos(pi() * {} / 7)) / 2"


@query(f"""
WITH s AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS p, 10 + vec_id % 5 AS a, 40 AS b FROM {_waves()}),
y AS (SELECT vec_id, v * (0.08 + 0.92 * CASE WHEN vec_id % 3 = 0 THEN 1 WHEN p < a OR p >= b THEN 0 WHEN p < a + 8 THEN {_RISE.format("(p - a)")}
  WHEN p >= b - 8 THEN {_RISE.format("(b - 1 - p)")} ELSE 1 END) AS y FROM s)
SELECT vec_id, count(*) AS n, round(max(abs(y)), 6) AS peak, round(sqrt(avg(y * y)), 6) AS rms FROM y GROUP BY vec_id""")
def vad_suppress(spark, sf_dir):
    """Signals turned down outside their speech, with fades of eight samples; every third has no speech and stays."""
    start = (10 + F.col("vec_id") % 5).cast("long")
    spans = table(spark, sf_dir, "embeddings").filter("vec_id % 3 <> 0").select("vec_id", start.alias("start"), F.lit(40).cast("long").alias("end"))
    return _wave_report(frames.masked(wave_frames(spark, sf_dir), ["vec_id"], spans, rate=400, size=FRAME))


@query(f"""
WITH s AS (SELECT vec_id, x, list_reverse(x)[1:20] AS w, unnest(generate_series(0, 47)) AS p FROM {_waves()}),
y AS (SELECT vec_id, CASE WHEN p < 12 THEN x[p + 1] WHEN p < 20 THEN x[p + 1] * (19 - p) / 7 + w[p - 11] * (p - 12) / 7
  WHEN p < 34 THEN coalesce(w[p - 11], 0) WHEN p < 42 THEN x[p + 17] * (p - 34) / 7 ELSE x[p + 17] END AS y FROM s)
SELECT vec_id, count(*) AS n, round(max(abs(y)), 6) AS peak, round(sqrt(avg(y * y)), 6) AS rms FROM y GROUP BY vec_id""")
def splice_padded(spark, sf_dir):
    """The last twenty samples, turned round and padded, in place of the samples from 20 to 50."""
    rows = waves(spark, sf_dir)
    new = F.reverse(F.slice("samples", -20, 20))
    cut = frames.to_frames(rows.select("vec_id", new.alias("new"), F.size("samples").alias("total"), "samples"), ["vec_id", "new", "total"], size=FRAME)
    make = lambda p: [dsp.Splice(np.array(p["new"]), 20, 50, p["total"], 400)]
    return _wave_report(frames.carried(cut, ["vec_id"], make, ["new", "total"], FRAME))


@query()
def splice(spark, sf_dir):
    """The first forty samples, turned round, in place of the samples from 20 to 50."""
    rows = waves(spark, sf_dir)
    new = F.reverse(F.slice("samples", -40, 40))
    cut = frames.to_frames(rows.select("vec_id", new.alias("new"), F.size("samples").alias("total"), "samples"), ["vec_id", "new", "total"], size=FRAME)
    make = lambda p: [dsp.Splice(np.array(p["new"]), 20, 50, p["total"], 400)]
    return _wave_report(frames.carried(cut, ["vec_id"], make, ["new", "total"], FRAME))


# -- transcripts: an order's lines are words, a supplier's remainder by three is the segment

_KEPT = "(l_quantity / 50)::DOUBLE >= 0.4"
_WORD = "l_returnflag || l_linenumber::VARCHAR"


def words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_suppkey") % 3).cast("int").alias("seg"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("word"),
        (F.col("l_quantity") / 50).cast("double").alias("prob"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_discount",
    )


def nested(rows: DataFrame) -> DataFrame:
    """(l_orderkey, segments) with words in line order."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "word", "prob", "l_discount")
    segs = rows.groupBy("l_orderkey", "seg").agg(
        F.array_sort(F.collect_list(order)).alias("x"), F.min("l_discount").alias("low")
    )
    listed = F.transform("x", lambda w: F.struct(w["word"].alias("word"), w["prob"].alias("prob")))
    text = F.when(F.col("seg") == 2, F.lit(" ...!")).otherwise(F.array_join(F.transform("x", lambda w: w["word"]), " "))
    segs = segs.select(
        "l_orderkey",
        F.struct(
            F.col("seg").alias("id"), (F.col("low") * 10).alias("no_speech"), text.alias("text"), listed.alias("words")
        ).alias("s"),
    )
    return segs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("segments"))


@query(f"SELECT l_orderkey, count(*) AS n, sum(CASE WHEN {_KEPT} THEN 1 ELSE 0 END)::BIGINT AS kept FROM lineitem GROUP BY ALL")
def word_filter(spark, sf_dir):
    kept = transcripts.keep_word(F.col("word"), F.col("prob"))
    return words(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"))


_SEGS = f"""
SELECT l_orderkey, l_suppkey % 3 AS seg, min(l_discount) * 10 AS quiet, sum(CASE WHEN {_KEPT} THEN 1 ELSE 0 END) AS kept,
  sum(CASE WHEN {_KEPT} THEN l_quantity / 50 ELSE 0 END) AS prob,
  string_agg({_WORD}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, {_WORD}, l_quantity, l_discount) AS text
FROM lineitem GROUP BY ALL"""
_CLEAN = f"""
SELECT l_orderkey, sum(kept)::BIGINT AS n_words, round((sum(prob) / sum(kept))::DOUBLE, 4) AS confidence, count(*) AS segs,
  string_agg(text, ' ' ORDER BY seg) AS text
FROM ({_SEGS}) WHERE quiet <= 0.6 AND seg <> 2 AND kept > 0 GROUP BY l_orderkey"""


@query(f"""
SELECT l_orderkey, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(confidence, 0)::DOUBLE AS confidence,
  segs IS NULL OR confidence < 0.45 OR n_words < 3 AS silent,
  CASE WHEN segs IS NULL OR confidence < 0.45 OR n_words < 3 THEN '' ELSE text END AS text
FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN ({_CLEAN}) USING (l_orderkey)""")
def transcript_clean(spark, sf_dir):
    out = transcripts.transcripts(nested(words(spark, sf_dir)))
    return out.select("l_orderkey", "n_words", "confidence", "silent", "text")


@query(f"""
SELECT l_orderkey, string_agg(text, ' ' ORDER BY seg) AS text FROM (
  SELECT l_orderkey, seg, CASE WHEN seg = 2 THEN '...!' ELSE text END AS text FROM ({_SEGS})) GROUP BY l_orderkey""")
def transcript_join(spark, sf_dir):
    return nested(words(spark, sf_dir)).select("l_orderkey", transcripts.joined_text(F.col("segments")).alias("text"))


@query("""
SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 3) AS made_up, o_orderkey % 5 <> 3 AS speech FROM orders""")
def transcript_reject(spark, sf_dir):
    texts = F.array(F.lit(" Thank you!!"), F.lit("[music]"), F.lit("thank them"), F.lit("..."), F.lit("so it is"))
    text = F.get(texts, (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", transcripts.is_silence_phrase(text).alias("made_up"), transcripts.has_speech(text).alias("speech")
    )


# -- jobs: an order is a job


def job_table(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "enhancing").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    url = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, "ftp://x").otherwise(F.concat(F.lit("https://x/"), key.cast("string")))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("recording_id"),
        F.lit("pipeline").alias("job_type"), status.alias("status"), (key % 4).cast("int").alias("attempts"),
        F.lit(8).alias("max_tags"), (key % 3 == 0).alias("callback_delivered"), url.alias("callback_url"),
        F.concat(F.lit("res"), key.cast("string")).alias("result_json"), F.lit("oops").alias("error"),
    )


_JOBS = """(SELECT o_orderkey AS id, 'r' || o_custkey AS recording_id,
  CASE o_orderstatus WHEN 'P' THEN 'enhancing' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
  (o_orderkey % 4)::INT AS attempts, o_orderkey % 3 = 0 AS callback_delivered,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'ftp://x' ELSE 'https://x/' || o_orderkey END
    AS callback_url FROM orders)"""


_FULL_JOBS = f"""(SELECT j.*, 'pipeline' AS job_type, 8 AS max_tags, 'res' || id AS result_json, 'oops' AS error,
  NULL::VARCHAR AS input_url, id % 2 = 0 AS skip_enhancement, FALSE AS skip_transcription,
  CASE WHEN id % 6 = 0 THEN 'said' END AS existing_transcript, NULL::VARCHAR AS custom_tags, o_orderdate AS created_at,
  CASE WHEN id % 3 > 0 THEN o_orderdate + INTERVAL 5 SECOND END AS started_at,
  CASE WHEN id % 3 > 1 THEN o_orderdate + INTERVAL 65 SECOND END AS completed_at
  FROM {_JOBS} j JOIN orders ON o_orderkey = id)"""
NOW = "2001-02-03 04:05:06"


def full_jobs(spark, sf_dir) -> DataFrame:
    """The jobs with all columns of the job table."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    later = lambda m, s: F.when(F.col("id") % 3 > m, F.col("created_at") + F.expr(f"INTERVAL {s} SECONDS"))
    nothing = F.lit(None).cast("string")
    return job_table(spark, sf_dir).join(orders, "id").withColumns(
        {
            "input_url": nothing, "skip_enhancement": F.col("id") % 2 == 0, "skip_transcription": F.lit(False), "custom_tags": nothing,
            "existing_transcript": F.when(F.col("id") % 6 == 0, "said"), "started_at": later(0, 5), "completed_at": later(1, 65),
        }
    )


def requests(spark, sf_dir) -> DataFrame:
    """One request for every second order, some for new ids, some twice."""
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0")
    key = F.col("o_orderkey")
    new = F.when(key % 10 == 0, key + 10_000_000).otherwise(key)
    once = rows.select(
        new.alias("id"), F.lit("q2").alias("recording_id"), F.lit("tagging").alias("job_type"), (key % 3).cast("int").alias("max_tags")
    )
    return once.unionByName(once.filter("id % 4 = 0").withColumn("recording_id", F.lit("q1")))


_REQUESTS = """(SELECT id AS rid, CASE WHEN id % 4 = 0 THEN 'q1' ELSE 'q2' END AS rec, min(tags) AS tags FROM (
  SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS id, o_orderkey % 3 AS tags
  FROM orders WHERE o_orderkey % 2 = 0) GROUP BY ALL)"""
#: What a finished job keeps, what starts anew, and what a new job has besides.
_SUBMITTED = f"""
SELECT coalesce(id, rid) AS id, CASE WHEN id IS NULL THEN rec ELSE recording_id END AS recording_id,
  CASE WHEN hit THEN 'tagging' ELSE job_type END AS job_type, CASE WHEN hit THEN 'pending' ELSE status END AS status,
  CASE WHEN hit THEN 0 ELSE attempts END::INT AS attempts, CASE WHEN hit THEN tags ELSE max_tags END::INT AS max_tags,
  CASE WHEN hit THEN FALSE ELSE callback_delivered END AS callback_delivered,
  CASE WHEN id IS NULL THEN 'https://x/hook' ELSE callback_url END AS callback_url,
  CASE WHEN NOT hit THEN result_json END AS result_json, CASE WHEN NOT hit THEN error END AS error, input_url,
  CASE WHEN id IS NULL THEN FALSE ELSE skip_enhancement END AS skip_enhancement,
  CASE WHEN id IS NULL THEN FALSE ELSE skip_transcription END AS skip_transcription, existing_transcript, custom_tags,
  CASE WHEN id IS NULL THEN TIMESTAMP '{NOW}' ELSE created_at END AS created_at,
  CASE WHEN NOT hit THEN started_at END AS started_at, CASE WHEN NOT hit THEN completed_at END AS completed_at, hit
FROM (SELECT j.*, w.*, rid IS NOT NULL AND (id IS NULL OR status NOT IN
    ('pending', 'enhancing', 'transcribing', 'categorizing', 'moderating')) AS hit FROM {{jobs}} j FULL JOIN {_REQUESTS} w ON j.id = w.rid)"""


@query(f"SELECT * EXCLUDE (hit) FROM ({_SUBMITTED.format(jobs=_FULL_JOBS)})")
def submit_upsert(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    return jobs.submit(full_jobs(spark, sf_dir), requests(spark, sf_dir), now, "https://x/hook")


_RECOVERED = "CASE WHEN status IN ('pending', 'enhancing') AND attempts < 3 THEN"


@query(f"""
WITH v1 AS {_FULL_JOBS}, v2 AS ({_SUBMITTED.format(jobs="v1")}),
v3 AS (SELECT * REPLACE ({_RECOVERED} 'pending' ELSE status END AS status, {_RECOVERED} attempts + 1 ELSE attempts END::INT AS attempts),
  status IN ('pending', 'enhancing') AND attempts < 3 AS back FROM v2),
v4 AS (SELECT * REPLACE ('cancelled' AS status) FROM v3 WHERE id % 7 = 0 AND status IN ('pending', 'enhancing')),
c AS (SELECT 1 AS version, id, status, attempts, recording_id, created_at FROM v1
  UNION ALL SELECT 2, id, status, attempts, recording_id, created_at FROM v2 WHERE hit
  UNION ALL SELECT 3, id, status, attempts, recording_id, created_at FROM v3 WHERE back
  UNION ALL SELECT 4, id, status, attempts, recording_id, created_at FROM v4)
SELECT version, id::VARCHAR AS id, status, attempts, recording_id, created_at,
  version = max(version) OVER (PARTITION BY id) AS current FROM c""")
def job_versions(spark, sf_dir):
    """The stored job table after a load, requests, a recovery and cancellations: each version's rows, and which are current."""
    store = versions.job_table(spark, scratch(spark, "jobs"))
    asked = requests(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    store.commit(0, full_jobs(spark, sf_dir).withColumn("id", F.col("id").cast("string")), whole=True)
    now = F.lit(NOW).cast("timestamp")
    store.update(lambda now_jobs: jobs.submit(now_jobs, asked, now, "https://x/hook", changed=True))
    store.update(lambda now_jobs: jobs.recover(now_jobs.filter(F.col("status").isin(*jobs.ACTIVE) & (F.col("attempts") < jobs.MAX_ATTEMPTS))))
    store.update(lambda now_jobs: jobs.cancel(now_jobs.filter("cast(id AS long) % 7 = 0 AND status IN ('pending', 'enhancing')"), now_jobs.select("id")))
    last = store.read().select("id", F.col("status").alias("s"), F.col("attempts").alias("a"))
    shown = store.changes().select(F.col(versions.VERSION).cast("int").alias("version"), "id", "status", "attempts", "recording_id", "created_at")
    newest = store.changes().groupBy("id").agg(F.max(versions.VERSION).alias("newest"))
    joined = shown.join(last, "id").join(newest, "id")
    current = (F.col("version") == F.col("newest")) & (F.col("status") == F.col("s")) & (F.col("attempts") == F.col("a"))
    return joined.select("version", "id", "status", "attempts", "recording_id", "created_at", current.alias("current"))


@query(f"""
SELECT id, CASE WHEN status = 'enhancing' AND attempts < 3 THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'enhancing' AND attempts < 3 THEN attempts + 1 ELSE attempts END::INT AS attempts FROM {_JOBS}""")
def recover_jobs(spark, sf_dir):
    return jobs.recover(job_table(spark, sf_dir)).select("id", "status", "attempts")


@query(f"""
SELECT id, CASE WHEN callback_url LIKE 'http%' THEN 'send' ELSE 'mark' END AS action FROM {_JOBS}
WHERE status IN ('completed', 'failed') AND callback_url IS NOT NULL AND NOT callback_delivered""")
def undelivered_callbacks(spark, sf_dir):
    return jobs.undelivered(job_table(spark, sf_dir)).select("id", "action")


_ERRORS = "['ValueError', 'TimeoutError', 'TypeError', 'OSError', 'HTTPStatusError'][o_orderkey % 5 + 1]"


@query(f"""
SELECT o_orderkey, CASE WHEN {_ERRORS} IN ('ValueError', 'TypeError', 'HTTPStatusError') OR o_orderkey % 4 >= 3
  THEN 'failed' ELSE 'pending' END AS status FROM orders""")
def failure_policy(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("ValueError", "TimeoutError", "TypeError", "OSError", "HTTPStatusError")])
    error = F.get(names, (F.col("o_orderkey") % 5).cast("int"))
    outcome = jobs.failure_outcome(error, F.lit(None).cast("int"), F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("status"))


@query(f"SELECT id, CASE WHEN id % 7 = 0 AND status = 'enhancing' THEN 'cancelled' ELSE status END AS status FROM {_JOBS}")
def cancel_jobs(spark, sf_dir):
    rows = job_table(spark, sf_dir)
    return jobs.cancel(rows, rows.filter("id % 7 = 0")).select("id", "status")


@query(f"""
SELECT id, attempts, CASE WHEN attempts = 0 THEN 2 ELSE least(2 * pow(2, attempts - 1), 300) END::DOUBLE AS callback_seconds,
  CASE WHEN attempts < 5 THEN 3 * pow(2, greatest(attempts, 1) - 1) END::DOUBLE AS fetch_seconds
FROM (SELECT id, (id % 11)::INT AS attempts FROM {_JOBS})""")
def callback_schedule(spark, sf_dir):
    """When each job's callback and fetch are tried next, by the tries that it had."""
    tries = (F.col("id") % 11).cast("int").alias("attempts")
    return job_table(spark, sf_dir).select("id", tries).select(
        "id", "attempts", jobs.callback_delay(F.col("attempts")).alias("callback_seconds"),
        jobs.fetch_delay(F.col("attempts")).alias("fetch_seconds"),
    )


def _answer(url: str, payload: str) -> int:
    """A receiver that takes some callbacks, is away for others, and refuses the rest."""
    last = int(url[-1])
    return 200 if last < 5 else 503 if last < 8 else 404


@query(f"""
SELECT id::VARCHAR AS id, CASE WHEN bad THEN 0 WHEN d BETWEEN 5 AND 7 THEN 4 ELSE 1 END::INT AS attempts,
  CASE WHEN bad THEN 'invalid' WHEN d < 5 THEN 'delivered' WHEN d < 8 THEN 'waiting' ELSE 'failed' END AS state,
  CASE WHEN bad THEN 0 WHEN d BETWEEN 5 AND 7 THEN 14 + 16 ELSE 2 END::BIGINT AS due_after, NOT bad AND d < 5 OR bad AS done
FROM (SELECT id, id % 10 AS d, callback_url NOT LIKE 'http%' AS bad FROM {_JOBS}
  WHERE status IN ('completed', 'failed') AND callback_url IS NOT NULL AND NOT callback_delivered)""")
def callback_outbox(spark, sf_dir):
    """The outbox after four batches, at the times when what wasn't taken is due again."""
    box = outbox.outbox_table(spark, scratch(spark, "outbox"))
    begin = dt.datetime(2001, 2, 3, 4, 5, 6, tzinfo=dt.UTC)
    rows = job_table(spark, sf_dir)
    box.update(lambda now: outbox.posted(rows, now, begin))
    for seconds in (0, 2, 6, 14):
        outbox.send_due(box, _answer, begin + dt.timedelta(seconds=seconds))
    found = box.read()
    done = outbox.delivered_jobs(rows, found).select(F.col("id").cast("string").alias("id"), F.lit(True).alias("done"))
    after = F.unix_seconds("next_due") - F.unix_seconds(F.lit(begin))
    return found.join(done, "id", "left").select("id", "attempts", "state", after.alias("due_after"), F.coalesce("done", F.lit(False)).alias("done"))


@query("""
SELECT o_orderkey, CASE WHEN c < 300 THEN 'delivered' WHEN c IN (400, 401, 403, 404, 422) THEN 'permanent' ELSE 'retry' END
  AS outcome, CASE WHEN o_orderkey % 6 = 0 THEN 404 WHEN o_orderkey % 3 = 0 THEN 409 WHEN o_orderkey % 4 = 0 THEN 400
  WHEN o_orderkey % 5 = 0 THEN 502 ELSE 200 END::INT AS code
FROM (SELECT o_orderkey, [200, 400, 404, 429, 500, 503, 422][o_orderkey % 7 + 1] AS c FROM orders)""")
def callback_outcomes(spark, sf_dir):
    key = F.col("o_orderkey")
    codes = F.get(F.array(*[F.lit(c) for c in (200, 400, 404, 429, 500, 503, 422)]), (key % 7).cast("int"))
    status = F.when(key % 3 == 0, "pending").otherwise("failed")
    url = F.when(key % 4 == 0, "").otherwise("https://x")
    code = jobs.retry_status(key % 6 != 0, status, url, key % 5 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", jobs.callback_outcome(codes).alias("outcome"), code.alias("code"))


_ODD_JOBS = """(SELECT *, CASE WHEN id % 7 = 0 THEN '' WHEN id % 7 = 1 THEN NULL ELSE 'tagging' END AS job_type,
  CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '' ELSE '{"tags":["#a",' || id || ']}' END AS result_json,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE 'no "luck"' END AS error FROM """ + _JOBS + ")"


def odd_jobs(spark, sf_dir) -> DataFrame:
    """Jobs with some types, results and errors missing or empty."""
    key = F.col("id")
    some = lambda m, v: F.when(key % m == 0, "").when(key % m == 1, F.lit(None)).otherwise(v)
    result = F.concat(F.lit('{"tags":["#a",'), key.cast("string"), F.lit("]}"))
    return job_table(spark, sf_dir).withColumns(
        {
            "job_type": some(7, F.lit("tagging")),
            "result_json": F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "").otherwise(result),
            "error": F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, "").otherwise('no "luck"'),
        }
    )


@query(f"""
SELECT id, '{{"job_id":' || id || ',"job_type":"' || CASE WHEN coalesce(job_type, '') = '' THEN 'pipeline' ELSE job_type END
  || '","status":"' || status || '","result":' || CASE WHEN status = 'failed' THEN 'null'
    WHEN coalesce(result_json, '') = '' THEN '{{}}' ELSE result_json END
  || ',"error":' || CASE WHEN status = 'completed' THEN 'null' WHEN coalesce(error, '') = '' THEN '"unknown"'
    ELSE '"no \\"luck\\""' END || '}}' AS payload
FROM {_ODD_JOBS} WHERE status IN ('completed', 'failed')""")
def result_payload(spark, sf_dir):
    return jobs.result_payload(odd_jobs(spark, sf_dir))


@query(f"""
WITH v AS (SELECT id, CASE WHEN coalesce(job_type, '') = '' THEN 'pipeline' ELSE job_type END AS job_type, status, recording_id,
    attempts, result_json AS result, error, callback_delivered, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
    CASE WHEN id % 3 > 0 THEN strftime(o_orderdate + INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S') END AS started_at,
    CASE WHEN id % 3 > 1 THEN strftime(o_orderdate + INTERVAL 65 SECOND, '%Y-%m-%d %H:%M:%S') END AS completed_at
  FROM {_ODD_JOBS} JOIN orders ON o_orderkey = id),
i AS (SELECT DISTINCT o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 10000000 ELSE 0 END AS id FROM orders)
SELECT i.id, v.* EXCLUDE (id), v.id IS NOT NULL AS found FROM i LEFT JOIN v ON i.id = v.id""")
def job_view(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    later = lambda m, s: F.when(F.col("id") % 3 > m, F.col("created_at") + F.expr(f"INTERVAL {s} SECONDS"))
    rows = odd_jobs(spark, sf_dir).join(orders, "id").withColumns({"started_at": later(0, 5), "completed_at": later(1, 65)})
    asked = F.col("id") + F.when(F.col("id") % 11 == 0, 10_000_000).otherwise(0)
    return jobs.job_view(rows, orders.select(asked.alias("id")))


@query("""
SELECT conv_id, count(*) AS n_tracks, count(*) FILTER ((conv_id + turn) % 4 <> 0) AS n_active,
  count(*) FILTER (turn % 2 = 0) AS n_enhanced, count(*) FILTER (turn % 3 = 0) AS n_transcribed FROM conversations GROUP BY conv_id""")
def processing_summary(spark, sf_dir):
    return tracks.processing_summary(_tracks(spark, sf_dir), "conv_id")


def _tracks(spark, sf_dir) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ((conv + turn) % 4 == 0).alias("is_muted"), (turn % 2 == 0).alias("is_enhanced"),
        (turn % 3 == 0).alias("has_transcription"), F.get(F.array(*map(F.lit, ("pipeline", "tagging", "magic_clean"))),
        (conv % 3).cast("int")).alias("job_type"), (conv % 5 == 0).alias("skip"), "text",
    )


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 4 <> 0")
def active_tracks(spark, sf_dir):
    return _tracks(spark, sf_dir).filter("NOT is_muted").select("conv_id", "turn")


@query("""
SELECT conv_id, turn, conv_id % 5 <> 0 AND turn % 2 <> 0 AND conv_id % 3 <> 1 AS enhance,
  trim(text) <> '' AND turn % 4 <> 0 AND conv_id % 3 <> 2 AS categorize FROM conversations""")
def should_enhance(spark, sf_dir):
    rows = _tracks(spark, sf_dir)
    enhance = jobs.should_enhance(F.col("skip"), F.col("is_enhanced"), F.col("job_type"))
    categorize = jobs.may_categorize(F.col("text"), F.col("turn") % 4 == 0, F.col("job_type"))
    return rows.select("conv_id", "turn", enhance.alias("enhance"), categorize.alias("categorize"))


@query("""
SELECT conv_id, conv_id % 5 <> 0 AND conv_id % 2 = 0 AND conv_id % 3 = 0 AND n = 0 AS gate FROM (
  SELECT conv_id, count(*) FILTER (turn % 3 = 0 AND turn > 0) AS n FROM conversations GROUP BY conv_id)""")
def no_speech_gate(spark, sf_dir):
    done = F.count_if(F.col("has_transcription") & (F.col("turn") > 0)).alias("n")
    rows = _tracks(spark, sf_dir).groupBy("conv_id").agg(done, F.first("skip").alias("skip"))
    text = F.when(F.col("conv_id") % 2 == 0, "").otherwise("x")
    old = F.when(F.col("conv_id") % 3 == 0, F.lit(None).cast("string")).otherwise("old")
    return rows.select("conv_id", jobs.no_speech(text, F.col("skip"), old, F.col("n")).alias("gate"))


@query("""
SELECT page_id, regexp_replace(url, '^http://', 'https://') AS url, page_id % 5 IN (0, 1, 3, 4) AND page_id % 7 <> 0 AS allowed
FROM pages""")
def download_predicates(spark, sf_dir):
    from brindle.functions.text import https

    kinds = F.array(F.lit("audio/x-foo; charset=x"), F.lit(" application/octet-stream"), F.lit("text/html"), F.lit("audio/wav"), F.lit(None))
    kind = F.get(kinds, (F.col("page_id") % 5).cast("int"))
    url = https(F.col("url"))
    allowed = jobs.allowed_download(url, kind, F.col("page_id") % 7)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), allowed.alias("allowed"))


@query("""
SELECT conv_id, turn, 'enhanced/' || conv_id || '/j' || conv_id || '-' || turn || '.wav' AS enhanced,
  'masters/' || conv_id || '/j' || conv_id || '.wav' AS master,
  'reconstructed/' || conv_id || '/' || substr(md5(conv_id || '|' || turn), 1, 16) || '.wav' AS spliced FROM conversations""")
def object_keys(spark, sf_dir):
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    job = F.concat(F.lit("j"), conv)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", jobs.key_of("enhanced", conv, job, turn).alias("enhanced"),
        jobs.key_of("masters", conv, job).alias("master"), jobs.key_of("reconstructed", conv, turn).alias("spliced"),
    )


# -- events: a user is a job


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS status FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    return jobs.latest_status(rows, "user_id", ["ts", "event_id"], "status")


_GAP = "epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""
SELECT user_id, event_id, round(gap, 3) AS gap, floor(gap / 86400)::BIGINT AS beats FROM (
  SELECT user_id, event_id, ({_GAP}) / 1e6 AS gap FROM events) WHERE gap > 86400""")
def heartbeat_gaps(spark, sf_dir):
    out = ev.heartbeat_gaps(table(spark, sf_dir, "events"), "user_id", "ts", ["event_id"], 86_400.0)
    return out.select("user_id", "event_id", F.round("gap", 3).alias("gap"), F.col("beats").cast("long").alias("beats"))


@query("""
SELECT user_id, event_id, place FROM (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) WHERE place <= 8""")
def bounded_buffer(spark, sf_dir):
    out = ev.bounded_buffer(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 8)
    return out.select("user_id", "event_id", "place")


def subscriptions(rows: DataFrame) -> DataFrame:
    """Subscribers of the events' users: they join with their first view, the second of them leaves ten days later."""
    who = F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))
    seen = rows.filter("event_type = 'view'").select(F.col("user_id").alias("job_id"), who.alias("subscriber"), F.col("ts").cast("timestamp").alias("ts"))
    first = seen.groupBy("job_id", "subscriber").agg(F.min("ts").alias("joined"))
    return first.withColumn("gone", F.when(F.col("subscriber") == "s1", F.col("joined") + F.expr("INTERVAL 10 DAYS")))


@query("""
WITH s AS (SELECT user_id AS job_id, 's' || event_id % 3 AS subscriber, min(ts) AS joined FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT job_id, subscriber, count(*) AS n, min(ts)::TIMESTAMP AS first, max(ts)::TIMESTAMP AS last, sum(event_id)::BIGINT AS ids
FROM events JOIN s ON job_id = user_id AND ts >= joined AND (subscriber <> 's1' OR ts <= joined + INTERVAL 10 DAY) GROUP BY ALL""")
def fan_out(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    told = rows.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("payload"))
    out = delivery.fan_out(told, subscriptions(rows)).groupBy("job_id", "subscriber")
    return out.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(F.col("payload").cast("long")).alias("ids"))


_STATUS = "['pending', 'enhancing', 'transcribing', 'moderating', 'categorizing', 'completed', 'failed', 'cancelled']"


@query(f"""
WITH e AS (SELECT user_id AS job_id, event_id, {_STATUS}[event_id * 5 % 8 + 1] AS after, event_id * 5 % 8 AS k,
  lag(event_id * 5 % 8) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT job_id, event_id, {_STATUS}[b + 1] AS before, after FROM e
WHERE NOT CASE WHEN b IS NULL THEN k = 0 WHEN k = 0 THEN b > 0 WHEN b >= 5 THEN FALSE WHEN k >= 6 THEN TRUE ELSE k > b END""")
def illegal_steps(spark, sf_dir):
    """Steps that the state machine doesn't know, of jobs whose states come in a scrambled order."""
    names = F.array(*[F.lit(s) for s in (*delivery.STATES, "failed", "cancelled")])
    status = F.get(names, (F.col("event_id") * 5 % 8).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", status.alias("status"))
    return delivery.illegal_steps(rows, ["event_id"])


def job_events(rows: DataFrame) -> DataFrame:
    """Table events as job events: purchases end a job, the others are segments."""
    kinds = F.when(F.col("event_type") == "purchase", "pipeline_complete").otherwise("transcript_segment")
    return rows.select(F.col("user_id").alias("job_id"), kinds.alias("event"), "ts", F.col("props").alias("payload"))


@query("""
WITH e AS (SELECT user_id AS job_id, event_type = 'purchase' AS last, ts, props AS payload FROM events),
f AS (SELECT job_id, min(ts) AS t FROM e WHERE last GROUP BY job_id)
SELECT f.job_id, count(payload) AS n_segments, coalesce(string_agg(payload, ' ' ORDER BY ts, payload), '') AS transcript,
  'pipeline_complete' AS outcome
FROM f LEFT JOIN (SELECT * FROM e WHERE NOT last) s ON s.job_id = f.job_id AND s.ts <= f.t GROUP BY f.job_id""")
def stream_fold(spark, sf_dir):
    return ev.fold_batch(job_events(table(spark, sf_dir, "events")))


_LIVE_RULES = [("view|click", "#Looking"), ("cart", "#Buying"), ("signup|login", "#Joining"), ("zzz", "#Never")]
_LIVE = ", ".join(f"({i}, '\\b(?:{p})\\b', '{t}')" for i, (p, t) in enumerate(_LIVE_RULES))


@query(f"""
WITH e AS (SELECT user_id AS job_id, event_type = 'purchase' AS last, ts, replace(event_type, '_', ' ') AS payload FROM events),
f AS (SELECT job_id, min(ts) AS t FROM e WHERE last GROUP BY job_id),
j AS (SELECT f.job_id, count(payload) AS n_segments, coalesce(string_agg(payload, ' ' ORDER BY ts, payload), '') AS transcript
  FROM f LEFT JOIN (SELECT * FROM e WHERE NOT last) s ON s.job_id = f.job_id AND s.ts <= f.t GROUP BY f.job_id),
r AS (SELECT job_id, tag, pos, least(1.0, len(regexp_extract_all(transcript, pattern)) * 0.15 + 0.4) AS score
  FROM j, (VALUES {_LIVE}) AS v(pos, pattern, tag) WHERE regexp_matches(transcript, pattern))
SELECT job_id, n_segments, coalesce(tags, '') AS tags FROM j LEFT JOIN (
  SELECT job_id, string_agg(tag, ',' ORDER BY score DESC, pos) AS tags FROM r GROUP BY job_id) USING (job_id)""")
def live_results(spark, sf_dir):
    """Realtime jobs, folded and categorised; the stream of the same is tested to give the same."""
    from brindle.plans.live import batch_results
    from brindle.sources.vocabulary import Rule, Vocabulary

    words = Vocabulary(["Shop"], [t for _, t in _LIVE_RULES], [Rule(p, t) for p, t in _LIVE_RULES])
    rows = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "pipeline_complete").otherwise("transcript_segment")
    told = rows.select(F.col("user_id").alias("job_id"), kind.alias("event"), "ts", F.replace("event_type", F.lit("_"), F.lit(" ")).alias("payload"))
    out = batch_results(told, words)
    return out.select("job_id", "n_segments", F.array_join("result.tags", ",").alias("tags"))


@query(f"""
SELECT vec_id, round(list_sum(list_transform(x, lambda v, i: v * (0.08 + 0.92 * CASE WHEN i % 3 = 0 THEN 1 ELSE 0.25 END))), 6) AS quiet,
  len(x[11:50])::BIGINT AS n, round(x[15] * (1 - cos(pi() * 4 / 7)) / 2, 6) AS faded, round(x[30], 6) AS kept FROM {_waves()}""")
def suppress_strip(spark, sf_dir):
    """Samples turned down outside a mask, and the ends cut off with fades of eight samples."""
    mask = F.transform("samples", lambda v, i: F.when((i + 1) % 3 == 0, 1.0).otherwise(0.25))
    cut = sg.strip_silence(F.col("samples"), F.lit(10), F.lit(50), 8)
    rows = waves(spark, sf_dir).select("vec_id", sg.total(sg.suppress(F.col("samples"), mask)).alias("q"), cut.alias("cut"))
    return rows.select(
        "vec_id", F.round("q", 6).alias("quiet"), F.size("cut").cast("long").alias("n"), F.round(F.get("cut", F.lit(4)), 6).alias("faded"),
        F.round(F.get("cut", F.lit(19)), 6).alias("kept"),
    )


@query(f"""
SELECT l_orderkey, coalesce(n, 0)::BIGINT AS n_words, coalesce(p, 0)::DOUBLE AS confidence, coalesce(t, '') AS text
FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (
  SELECT l_orderkey, sum(n) AS n, round((sum(p) / sum(n))::DOUBLE, 4) AS p, string_agg(text, ' ' ORDER BY seg) AS t FROM (
    SELECT l_orderkey, l_suppkey % 3 AS seg, count(*) AS n, sum(l_quantity / 50) AS p,
      string_agg({_WORD}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, {_WORD}, l_quantity, l_discount) AS text
    FROM lineitem WHERE l_suppkey % 3 <> 2 GROUP BY ALL) GROUP BY l_orderkey) USING (l_orderkey)""")
def transcript_lenient(spark, sf_dir):
    """Cleaning that keeps improbable words and quiet segments."""
    out = transcripts.transcripts(nested(words(spark, sf_dir)), strict=False)
    return out.select("l_orderkey", "n_words", "confidence", "text")


_ODD_LINES = """(SELECT c_custkey, CASE c_custkey % 6
  WHEN 0 THEN '{"id": "c' || c_custkey || '", "title": "t", "tracks": [{"id": "x", "volume": 0.5}, {"id": "y"}], "other": 1}'
  WHEN 1 THEN '{"id": "c' || c_custkey || '", "tracks": [' WHEN 2 THEN '{"title": "no id"}' WHEN 3 THEN '   '
  WHEN 4 THEN '{"id": "c' || c_custkey || '", "tracks": null}' ELSE '[1, 2]' END AS line FROM customer)"""


@query(f"""
SELECT CASE c_custkey % 6 WHEN 0 THEN 'recording' WHEN 4 THEN 'recording' WHEN 2 THEN 'no id' ELSE 'malformed' END AS outcome,
  count(*) AS n, sum(CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 0 END)::BIGINT AS tracks
FROM {_ODD_LINES} WHERE c_custkey % 6 <> 3 GROUP BY 1""")
def recording_rejects(spark, sf_dir):
    """Good and bad JSON lines of recordings, written by the customers' number and read back."""
    from brindle.sources.recordings import split_recordings

    key = F.col("c_custkey")
    begin = F.concat(F.lit('{"id": "c'), key.cast("string"), F.lit('", '))
    line = (
        F.when(key % 6 == 0, F.concat(begin, F.lit('"title": "t", "tracks": [{"id": "x", "volume": 0.5}, {"id": "y"}], "other": 1}')))
        .when(key % 6 == 1, F.concat(begin, F.lit('"tracks": ['))).when(key % 6 == 2, F.lit('{"title": "no id"}'))
        .when(key % 6 == 3, F.lit("   ")).when(key % 6 == 4, F.concat(begin, F.lit('"tracks": null}'))).otherwise("[1, 2]")
    )
    path = scratch(spark, "lines")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    good, bad = split_recordings(spark, path)
    rows = good.select(F.lit("recording").alias("outcome"), F.coalesce(F.when(F.size("tracks") >= 0, F.size("tracks")), F.lit(0)).alias("k"))
    rows = rows.unionByName(bad.select(F.col("reason").alias("outcome"), F.lit(0).alias("k")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("tracks"))


@query("""
SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 4 <> 0 AND NOT (turn % 3 = 0 AND trim(coalesce(text, '')) <> '')""")
def untranscribed_tracks(spark, sf_dir):
    rows = _tracks(spark, sf_dir)
    said = rows.filter("has_transcription").select("conv_id", "turn", "text")
    return tracks.untranscribed(rows, said, ["conv_id", "turn"]).select("conv_id", "turn")


# -- further records


@query(f"""
WITH p AS (SELECT rec_id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM {_waves()}),
m AS (SELECT rec_id, pos, avg(v) AS v FROM p GROUP BY ALL)
SELECT rec_id, count(*) AS n, round(sum(abs(v)), 6) AS total FROM m GROUP BY rec_id""")
def to_mono(spark, sf_dir):
    from brindle.operators.enhance import to_mono as mono

    total = sg.total(F.transform("samples", lambda v: F.abs(v)))
    out = mono(waves(spark, sf_dir), "rec_id")
    return out.select("rec_id", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn / 10::DOUBLE ELSE 1.0 END AS quality,
  CASE WHEN turn % 3 = 0 THEN turn * 2::DOUBLE ELSE 50.0 END AS snr FROM conversations WHERE turn % 2 = 0 OR turn % 5 = 1""")
def enhanced_passthrough(spark, sf_dir):
    from brindle.sources.recordings import passthrough_scores

    turn = F.col("turn")
    quality, snr = passthrough_scores(
        F.when(turn % 2 == 0, turn / F.lit(10.0)), F.when(turn % 3 == 0, turn * F.lit(2.0))
    )
    rows = table(spark, sf_dir, "conversations").filter("turn % 2 = 0 OR turn % 5 = 1")
    return rows.select("conv_id", "turn", quality.alias("quality"), snr.alias("snr"))


@query("""
SELECT count(*) FILTER (o_orderstatus = 'P') AS active, count(*) FILTER (o_orderstatus = 'F') AS failed,
  count(*) FILTER (o_orderkey % 4 >= 3) AS spent FROM orders""")
def queue_counters(spark, sf_dir):
    rows = job_table(spark, sf_dir)
    return rows.agg(
        F.count_if(F.col("status").isin(*jobs.ACTIVE)).alias("active"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("attempts") >= jobs.MAX_ATTEMPTS).alias("spent"),
    )


@query("""
SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY user_id""")
def job_durations(spark, sf_dir):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("b"), F.min("ts").alias("a"))
    return rows.select("user_id", F.round((micros(F.col("b")) - micros(F.col("a"))) / 1e6, 3).alias("seconds"))


@query("""
SELECT o_orderkey, array_to_string(CASE o_orderkey % 3 WHEN 0 THEN ['a', 'b', 'a', 'c'] WHEN 1 THEN ['c', 'a', 'b'] ELSE ['a', 'b', 'c'] END, ',') AS tags,
  CASE o_orderkey % 3 WHEN 0 THEN 'a,a' WHEN 1 THEN '' ELSE 'a' END AS known FROM orders""")
def custom_tags(spark, sf_dir):
    from brindle.plans.categorize import known_only, wanted_tags

    own = lambda *x: F.array(*map(F.lit, x))
    key = F.col("o_orderkey") % 3
    custom = F.when(key == 0, own("a", "b", "a")).when(key == 1, own("c")).otherwise(own("a", "b"))
    auto = F.when(key == 0, own("b", "c")).when(key == 1, own("a", "b", "a", "c")).otherwise(own("c", "a", "c"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array_join(wanted_tags(custom, auto), ",").alias("tags"),
        F.array_join(known_only(custom, ["x", "a"]), ",").alias("known"),
    )


@query("""
SELECT o_orderkey, CASE WHEN i = 'safe' THEN 'none' ELSE s END AS severity, i AS intent,
  CASE WHEN i = 'safe' THEN FALSE WHEN i = 'harmful' AND s IN ('high', 'critical') THEN TRUE ELSE f END AS flagged
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'none' ELSE 'critical' END AS s,
  CASE o_orderkey % 3 WHEN 0 THEN 'harmful' WHEN 1 THEN 'questionable' ELSE 'safe' END AS i, o_orderkey % 5 = 0 AS f FROM orders)""")
def clamp_verdict(spark, sf_dir):
    from brindle.operators.moderation import clamp_verdict as clamp

    pick = lambda m, *x: F.get(F.array(*map(F.lit, x)), (F.col("o_orderkey") % m).cast("int"))
    severity, intent, flagged = clamp(
        pick(4, "high", "low", "extreme", "critical"), pick(3, "harmful", "questionable", "odd"), F.col("o_orderkey") % 5 == 0
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", severity.alias("severity"), intent.alias("intent"), flagged.alias("flagged")
    )


@query("""
SELECT conv_id, count(*) AS n_tracks, max(turn)::BIGINT AS last, count(*) FILTER (turn % 5 = 0) AS flagged
FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id""")
def per_track_results(spark, sf_dir):
    from brindle.plans.categorize import assemble

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    rows = rows.withColumn("track", F.col("conv_id") * 1000 + F.col("turn"))
    verdicts = rows.select("track", (F.col("track") % 5 == 0).alias("flagged"))
    out = assemble(rows, verdicts, "conv_id", "track")
    values = F.map_values("per_track")
    return out.select(
        "conv_id",
        F.size("per_track").cast("long").alias("n_tracks"),
        (F.array_max(F.map_keys("per_track")) % 1000).alias("last"),
        F.size(F.filter(values, lambda v: v["flagged"])).cast("long").alias("flagged"),
    )


@query()
def enhance_tracks(spark, sf_dir):
    """A third each music, speech and podcasts; the latter with the next signals as drums and bass."""
    from brindle.operators.enhance import enhance

    mode = F.get(F.array(*map(F.lit, ("music", "speech", "podcast"))), (F.col("vec_id") % 3).cast("int"))
    rows = wave_frames(spark, sf_dir)
    stem = F.when(F.col("vec_id") % 3 == 0, "drums").when(F.col("vec_id") % 3 == 1, "bass").otherwise("vocals")
    stems = rows.withColumn("stem", stem).withColumn("vec_id", F.floor(F.col("vec_id") / 3) * 3 + 2)
    _, report = enhance(rows.withColumn("mode", mode), ["vec_id"], 8000, stems=stems, size=FRAME)
    return report.select("vec_id", "mode", "snr_db", "clipped", "quality")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 8 IN (0, 1, 6, 7) THEN lower(s_name) || '|two' ELSE '' END AS blocked,
  CASE WHEN s_suppkey % 8 IN (0, 1, 7) THEN '' WHEN s_suppkey % 8 = 6 THEN 'news|chess' ELSE '' END AS auto FROM supplier""")
def settings_answer(spark, sf_dir):
    """Platform settings out of good and bad answers."""
    from brindle.sources.recordings import settings_of

    k, name = F.col("s_suppkey") % 8, F.concat(F.lit('{"blocked_keywords": " '), F.col("s_name"), F.lit(', ,Two"'))
    body = (
        F.when(k == 0, F.concat(name, F.lit("}"))).when(k == 1, F.concat(name, F.lit(', "other": 5}')))
        .when(k == 2, F.concat(name, F.lit(', "auto_tag_keywords": null}'))).when(k == 3, name).when(k == 4, F.lit("[1]"))
        .when(k == 5, F.concat(name, F.lit("}"))).when(k == 6, F.concat(name, F.lit(', "auto_tag_keywords": "News,Chess"}')))
        .otherwise(F.concat(name, F.lit(', "auto_tag_keywords": ""}')))
    )
    code = F.when(k == 5, 503).otherwise(200)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", settings_of(body, code).alias("x"))
    return rows.select("s_suppkey", *[F.array_join(f"x.{c}", "|").alias(c) for c in ("blocked", "auto")])


@query("""
SELECT o_orderkey, created_at FROM (SELECT o_orderkey, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k
  FROM orders WHERE o_orderkey % 3 = 1) WHERE k <= 50""")
def next_jobs(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 == 1, "pending").otherwise("completed").alias("status")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), status)
    return jobs.next_jobs(rows, 50).select(F.col("id").alias("o_orderkey"), "created_at")


def _realtime(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as realtime jobs: their turns are tracks, a turn's sentences its segments."""
    rows = table(spark, sf_dir, "conversations")
    a, b = F.col("conv_id"), F.col("turn")
    fault = F.when((a + b) % 11 == 0, "ValueError").when((a + b * 2) % 6 == 0, "RuntimeError")
    said = F.filter(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+"), lambda s: F.trim(s) != "")
    of_tracks = rows.select(
        a.alias("job_id"), b.cast("string").alias("track_id"), b.alias("position"), ((a + b) % 7 == 0).alias("is_muted"),
        ((a + b) % 3 == 0).alias("is_enhanced"), ((a + b) % 5 == 0).alias("has_transcription"),
        F.when((a * 5 + b) % 4 == 1, "too short").alias("enhancement_error"), said.alias("segments"), fault.alias("error_class"),
    )
    error = F.when(F.col("job_id") % 9 == 4, "no recording").alias("error")
    return rows.select(a.alias("job_id")).distinct().select("job_id", error), of_tracks, ev.segment_source(of_tracks)


_TURN_TRACKS = """(
  SELECT conv_id AS job_id, turn::VARCHAR AS track_id, turn AS pos, (conv_id + turn) % 7 = 0 AS muted, (conv_id + turn) % 3 = 0 AS enhanced,
    (conv_id + turn) % 5 = 0 AS transcribed, (conv_id * 5 + turn) % 4 = 1 AS failed,
    list_filter(string_split_regex(coalesce(text, ''), '[.!?\n]+'), lambda s: trim(s) <> '') AS words,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN 'ValueError' WHEN (conv_id + turn * 2) % 6 = 0 THEN 'RuntimeError' END AS fault
  FROM conversations)"""
_TURN_SEGMENTS = f"""(
  SELECT job_id, track_id, pos, i - 1 AS seq, 'segment' AS kind, words[i] AS text, false AS silent
  FROM {_TURN_TRACKS}, unnest(range(1, len(words) + 1)) u(i)
  UNION ALL SELECT job_id, track_id, pos, len(words), CASE WHEN coalesce(fault, 'ValueError') = 'ValueError' THEN 'done' ELSE 'error' END,
    NULL, coalesce(fault = 'ValueError', false) FROM {_TURN_TRACKS})"""


@query(f"SELECT job_id, track_id, seq, kind, text, silent FROM {_TURN_SEGMENTS}")
def segment_source(spark, sf_dir):
    return _realtime(spark, sf_dir)[2].withColumn("seq", F.col("seq").cast("long"))


@query(f"""
WITH t AS (SELECT * FROM {_TURN_TRACKS} WHERE NOT muted AND job_id % 9 <> 4),
s AS (SELECT g.job_id, g.track_id, g.pos, seq, kind FROM {_TURN_SEGMENTS} g JOIN t USING (job_id, track_id) WHERE NOT transcribed),
j AS (SELECT DISTINCT conv_id AS job_id, conv_id % 9 = 4 AS bad FROM conversations),
e AS (
  SELECT job_id, 0 AS stage, NULL AS pos, 0 AS step, 0 AS seq, 'pipeline_started' AS event, NULL AS track_id FROM j
  UNION ALL SELECT job_id, 0, NULL, 0, 1, 'recording_fetched', NULL FROM j WHERE NOT bad
  UNION ALL SELECT job_id, 1, pos, 0, 0, 'track_started', track_id FROM t
  UNION ALL SELECT job_id, 1, pos, 1, 0, CASE WHEN enhanced THEN 'enhancement_skipped' ELSE 'enhancement_started' END, track_id FROM t
  UNION ALL SELECT job_id, 1, pos, 2, 0, CASE WHEN failed THEN 'enhancement_error' ELSE 'enhancement_complete' END, track_id
    FROM t WHERE NOT enhanced
  UNION ALL SELECT job_id, 1, pos, 3, 0, 'transcript_skipped', track_id FROM t WHERE transcribed
  UNION ALL SELECT job_id, 1, pos, 3, seq,
    CASE kind WHEN 'segment' THEN 'transcript_segment' WHEN 'done' THEN 'transcript_complete' ELSE 'transcript_error' END, track_id FROM s
  UNION ALL SELECT DISTINCT job_id, 2, NULL::BIGINT, 0, 0, 'categorization_complete', NULL FROM s WHERE kind = 'segment'
  UNION ALL SELECT job_id, 2, NULL, 0, 1, CASE WHEN bad THEN 'pipeline_error' ELSE 'pipeline_complete' END, NULL FROM j)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY stage, pos, step, seq) AS place, event, track_id FROM e""")
def event_sequence(spark, sf_dir):
    return ev.event_sequence(*_realtime(spark, sf_dir))


@query(f"""
SELECT job_id, count(*) AS n_tracks, count(*) FILTER (failed AND NOT enhanced) AS n_failed, 'completed' AS realtime,
  CASE WHEN bool_or(failed AND NOT enhanced) THEN 'failed' ELSE 'completed' END AS batch
FROM {_TURN_TRACKS} WHERE NOT muted GROUP BY job_id""")
def track_failures(spark, sf_dir):
    rows = _realtime(spark, sf_dir)[1]
    realtime = ev.track_failures(rows, True).withColumnRenamed("outcome", "realtime")
    batch = ev.track_failures(rows, False).select("job_id", F.col("outcome").alias("batch"))
    return realtime.join(batch, "job_id")
