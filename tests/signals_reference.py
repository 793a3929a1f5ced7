"""Whole signals through the filters sample by sample: what frames must come to."""

import math

import numpy as np


def follow(x, rise, fall, start=0.0):
    out, p = [], start
    for v in x:
        c = rise if v > p else fall
        p = c * p + (1 - c) * v
        out.append(p)
    return np.array(out)


def section(x, b, a):
    out, s1, s2 = [], 0.0, 0.0
    for v in x:
        y = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * y + s2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


def gate(x, rate, threshold_db, rise_ms=1, fall_ms=150, hold_ms=50):
    rise, fall = (math.exp(-1000 / (rate * ms)) for ms in (rise_ms, fall_ms))
    held, left = [], 0
    for e in follow(np.abs(x), rise, fall):
        left = int(rate * hold_ms / 1000) + 1 if e > 10 ** (threshold_db / 20) else left
        held.append(float(left > 0))
        left = max(left - 1, 0)
    return x * follow(held, rise, fall, 1.0)


def compress(x, threshold_db, ratio, makeup_db, rise_ms, fall_ms, rate):
    rise, fall = (math.exp(-1000 / (rate * ms)) for ms in (rise_ms, fall_ms))
    t = 10 ** (threshold_db / 20)
    gains = [(t + (e - t) / ratio) / (e + 1e-12) if e > t else 1.0 for e in follow(np.abs(x), rise, fall)]
    out = x * np.clip(follow(gains, fall, fall), 0, 1) * 10 ** (makeup_db / 20)
    top = np.abs(out).max(initial=0)
    return out * 0.99 / top if top > 0.99 else out


def loudness(y, raw, rate):
    """Of the weighted signal ``y``, block by block."""
    size = int(0.4 * rate)
    if len(raw) < size:
        return 20 * math.log10(math.sqrt(np.mean(raw * raw)) + 1e-8) if len(raw) else -99.0
    power = np.array([np.mean(y[s : s + size] ** 2) for s in range(0, len(y) - size + 1, size // 4)])
    level = -0.691 + 10 * np.log10(np.maximum(power, 1e-30))
    kept = level >= -70
    if not kept.any():
        return -99.0
    kept &= level > -0.691 + 10 * math.log10(power[kept].mean()) - 10
    return -0.691 + 10 * math.log10(power[kept].mean()) if kept.any() else -99.0


def resample(x, rate, target, width=6, rolloff=0.99):
    cut = min(1.0, target / rate) * rolloff
    out = []
    for j in range(-(-len(x) * target // rate)):
        at = np.arange(max(0, int(j * rate / target - width / cut) - 2), min(len(x), int(j * rate / target + width / cut) + 3))
        t = (at - j * rate / target) * cut
        weight = np.where(np.abs(t) < width, np.sinc(t) * np.cos(np.pi * t / width / 2) ** 2 * cut, 0)
        out.append(weight @ x[at])
    return np.array(out)
