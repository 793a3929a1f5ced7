"""Signals in frames equal whole signals, at any frame length."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import dsp
from brindle.operators import enhance as en
from brindle.operators import frames as fr
from tests import signals_reference as ref

RNG = np.random.default_rng(4)
X = RNG.normal(size=1500) * np.repeat([0.02, 0.6, 0.001, 1.2, 0.3], 300)
SIZES = (1, 7, 64, 100, 5000)


def pieces(x, size):
    return [x[i : i + size] for i in range(0, len(x), size)] or [x]


def run(make, x, size):
    filters = make()
    return np.concatenate([_through(filters, p) for p in pieces(x, size)])


def _through(filters, x):
    for f in filters:
        x = f(x)
    return x


@pytest.mark.parametrize("size", SIZES)
def test_filters_carry_their_state(size):
    near = lambda a, b: np.abs(a - b).max() < 1e-9
    assert near(run(lambda: [dsp.Gate(1000, -30.0)], X, size), ref.gate(X, 1000, -30.0))
    for mode, given in dsp.COMPRESSOR.items():
        got = dsp.limit_peak(run(lambda m=mode: [dsp.Compressor(m, 8000)], X, size))
        assert near(got, ref.compress(X, *given, 8000))
    for bands in (dsp.SPEECH_EQ, dsp.MUSIC_EQ):
        whole = X
        for kind, f, gain_db, q in bands:
            if f < 8000:
                w = 2 * math.pi * f / 16_000
                alpha, c = math.sin(w) / (2 * q), math.cos(w)
                if kind == "peak":
                    g = 10 ** (gain_db / 40)
                    b, a = (1 + alpha * g, -2 * c, 1 - alpha * g), (1 + alpha / g, -2 * c, 1 - alpha / g)
                else:
                    s = 1 + c if kind == "high" else 1 - c
                    b, a = (s / 2, -s if kind == "high" else s, s / 2), (1 + alpha, -2 * c, 1 - alpha)
                whole = np.clip(ref.section(whole, [v / a[0] for v in b], [v / a[0] for v in a]), -1, 1)
        assert near(run(lambda b=bands: dsp.equaliser(b, 16_000), X, size), whole)
    for rate, target in ((8000, 32_000), (44_100, 16_000), (16_000, 44_100)):
        more = dsp.Resampler(rate, target)
        got = np.concatenate([*(more(p) for p in pieces(X[:600], size)), more.flush()])
        assert near(got, ref.resample(X[:600], rate, target))
    for new, start, end in ((np.ones(50), 200, 300), (np.ones(300), 200, 300), (np.ones(20), 0, 50), (np.ones(20), 1450, 1500)):
        whole = dsp.Splice(new, start, end, len(X), 1000)(X)
        assert near(run(lambda n=new, s=start, e=end: [dsp.Splice(n, s, e, len(X), 1000)], X, size), whole)


def tracks(spark, rows):
    return spark.createDataFrame([(k, x.tolist()) for k, x in rows], "track int, samples array<double>")


def by_track(df, column):
    return {r["track"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("size", [97, 1000, 70_000])
def test_measures_of_frames(spark, size):
    rate = 4000
    rows = [(1, np.tile(X, 4)), (2, X[:100]), (3, np.zeros(3000)), (4, np.empty(0)), (5, np.sin(np.arange(9000) / 3))]
    frames = fr.to_frames(tracks(spark, rows), ["track"], size=size)
    assert by_track(fr.from_frames(frames, ["track"]), "samples")[1] == rows[0][1].tolist()
    got = by_track(fr.loudness(frames, ["track"], rate), "lufs")
    for k, x in rows:
        y = x
        for f in dsp.k_weighting(rate):
            y = f(y)
        assert got[k] == pytest.approx(ref.loudness(y, x, rate), abs=1e-9)
    top = by_track(fr.true_peaks(frames, ["track"], rate), "peak")
    for k, x in rows:
        assert top[k] == pytest.approx(np.abs(ref.resample(x, rate, 4 * rate)).max(initial=0), abs=1e-9)
    level = by_track(fr.loudness(fr.normalised(frames, ["track"], -20.0, rate), ["track"], rate), "lufs")
    assert level[1] == pytest.approx(-20.0, abs=0.01) and level[5] == pytest.approx(-20.0, abs=0.01)
    held = by_track(fr.true_peaks(fr.limited_true_peak(frames, ["track"], rate=rate), ["track"], rate), "peak")
    assert max(held.values()) <= 10 ** (-1 / 20) + 1e-9


def test_mixing_frames(spark):
    rows = [(k % 3, RNG.normal(size=n)) for k, n in enumerate([50, 70, 5, 30, 90, 200, 1])]
    frames = fr.to_frames(tracks(spark, rows), ["track"], size=16).repartition(5)
    for mean in (False, True):
        got = by_track(fr.from_frames(fr.mixed(frames, ["track"], mean), ["track"]), "samples")
        for k in range(3):
            own = [x for t, x in rows if t == k]
            most = max(map(len, own))
            total = sum(np.pad(x, (0, most - len(x))) for x in own)
            there = sum(np.pad(np.ones(len(x)), (0, most - len(x))) for x in own)
            assert np.allclose(got[k], total / there if mean else total)


def test_mixing_many_tracks_in_little_memory(spark, monkeypatch):
    rows = [(k % 2, np.full(40, float(k))) for k in range(300)]
    frames = fr.to_frames(tracks(spark, rows), ["track"], size=1)  # more places than a task holds
    got = by_track(fr.from_frames(fr.mixed(frames, ["track"]), ["track"]), "samples")
    assert got[0] == [float(sum(range(0, 300, 2)))] * 40 and got[1] == [float(sum(range(1, 300, 2)))] * 40


def whole_chain(x, mode, rate):
    """The chain over a whole signal; spans, mask and stripping written plainly."""
    if mode == "music":
        return x, x
    size = int(rate * 0.03)
    loud = [20 * math.log10(math.sqrt(np.mean(x[i : i + size] ** 2)) + 1e-8) > -45 for i in range(0, len(x) - size + 1, size)]
    spans, fade = [], int(rate * 0.02)
    for i, on in enumerate(loud):
        if on and i and loud[i - 1]:
            spans[-1][1] = (i + 1) * size
        elif on:
            spans.append([i * size, (i + 1) * size])
    if spans:
        mask = np.zeros(len(x))
        for s, e in spans:
            part = np.ones(e - s)
            part[:fade] = (1 - np.cos(np.linspace(0, 1, fade) * np.pi)) / 2
            part[len(part) - fade :] = part[:fade][::-1]
            mask[s:e] = np.maximum(mask[s:e], part)
        x = x * (0.08 + 0.92 * mask)
    for f in dsp.equaliser(rate=rate):
        x = f(x)
    x = ref.gate(x, rate, -65.0)
    if mode == "speech" and spans:
        x = x[spans[0][0] : spans[-1][1]].copy()
        n = int(rate * 0.025)
        ramp = (1 - np.cos(np.linspace(0, 1, n) * np.pi)) / 2
        x[:n] *= ramp
        x[-n:] *= ramp[::-1]
    return x, ref.compress(x, *dsp.COMPRESSOR[mode], rate)


@pytest.mark.parametrize("size", [333, 9000])
def test_the_chain_in_frames(spark, size):
    rate = 8000
    speech = np.concatenate([np.zeros(1500), np.sin(np.arange(3000) / 5) * 0.4, np.zeros(2000), np.sin(np.arange(1500) / 9) * 0.3, np.zeros(700)])
    modes = {1: "music", 2: "speech", 3: "podcast", 4: "podcast"}
    frames = fr.to_frames(tracks(spark, [(k, speech) for k in modes]), ["track"], size=size)
    mode = F.element_at(F.create_map(*[F.lit(x) for kv in modes.items() for x in kv]), F.col("track"))
    drums = np.sin(np.arange(6000) / 2) * 0.2
    stems = fr.to_frames(tracks(spark, [(4, drums)]), ["track"], size=size).withColumn("stem", F.lit("drums"))
    out, report = en.enhance(frames.withColumn("mode", mode), ["track"], rate, stems=stems, size=size)
    got = by_track(fr.from_frames(out, ["track"]), "samples")
    told = by_track(report, "snr_db")
    for k, m in modes.items():
        clean, pressed = whole_chain(speech, m, rate)
        if k == 4:
            clean = clean[: len(drums)] + drums * 10 ** (-12 / 20)
            pressed = ref.compress(clean, *dsp.COMPRESSOR[m], rate)
        n = min(len(clean), len(speech))
        noise = np.mean((speech[:n] - clean[:n]) ** 2) + 1e-10
        assert told[k] == pytest.approx(10 * math.log10(max(np.mean(clean[:n] ** 2), 1e-10) / noise), abs=0.011)
        y = pressed
        for f in dsp.k_weighting(rate):
            y = f(y)
        level, goal = ref.loudness(y, pressed, rate), -14.0 if m == "music" else -16.0
        final = pressed if abs(level - goal) <= 0.5 else dsp.limit_peak(pressed * 10 ** ((goal - level) / 20))
        top = np.abs(ref.resample(final, rate, 4 * rate)).max()
        final = final * (10 ** (-1 / 20) / top) if top > 10 ** (-1 / 20) else final
        assert np.allclose(got[k], final, atol=1e-8)
