"""Recursive and spectral filters of mono signals that go on from one run of samples to the next.

They are the helpers of ``operators.frames``, which gives them the frames of a track in order.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

RATE = 44_100
#: threshold dB, ratio, makeup dB, attack ms, release ms
COMPRESSOR = {
    "speech": (-18.0, 2.5, 1.5, 5, 80),
    "music": (-12.0, 1.8, 0.5, 20, 200),
    "podcast": (-16.0, 2.0, 1.0, 10, 120),
}
#: kind, frequency, gain dB, Q
SPEECH_EQ = (
    ("high", 100.0, 0.0, 0.707), ("peak", 300.0, -2.0, 1.5), ("peak", 1000.0, 1.0, 2.0),
    ("peak", 3000.0, 2.5, 1.8), ("peak", 8000.0, 1.5, 2.0), ("low", 12000.0, 0.0, 0.707),
)
MUSIC_EQ = (("high", 30.0, 0.0, 0.707), ("peak", 100.0, 1.0, 1.2), ("peak", 3000.0, -1.0, 2.0), ("peak", 8000.0, 2.0, 1.5))


def constant(ms: float, rate: int = RATE) -> float:
    return math.exp(-1000.0 / (rate * ms))


@lru_cache(256)
def _matrices(b: tuple[float, ...], a: tuple[float, ...], m: int) -> tuple[np.ndarray, ...]:
    """What a section does to a block of ``m`` samples: the block's own answer, the state's, and the state after it."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    into = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(m):
        powers.append(powers[-1] @ step)
    answer = np.array([b[0], *[(powers[i] @ into)[0] for i in range(m - 1)]])
    lag = np.arange(m)[:, None] - np.arange(m)[None, :]
    direct = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0).T
    seen = np.array([p[0] for p in powers[:m]]).T
    return direct, seen, np.array([powers[m - 1 - i] @ into for i in range(m)]), powers[m], step, into


class Section:
    """A second-order recursive filter that goes on where the last samples ended.

    Blocks of samples are a matrix product each; only the two numbers of state go from block to block.
    """

    BLOCK = 64

    def __init__(self, b: list[float], a: list[float], hold: bool = False) -> None:
        self.direct, self.seen, self.gather, self.whole, self.step, self.into = _matrices(tuple(b), tuple(a), self.BLOCK)
        self.first, self.hold, self.state = b[0], hold, np.zeros(2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = len(x) // self.BLOCK
        out = np.empty(len(x))
        blocks = x[: n * self.BLOCK].reshape(n, self.BLOCK)
        came, states = blocks @ self.gather, np.empty((n, 2))
        (p, q), (r, s) = self.whole.tolist()
        u, v = self.state.tolist()
        for k, (c, d) in enumerate(came.tolist()):
            states[k] = u, v
            u, v = p * u + q * v + c, r * u + s * v + d
        out[: n * self.BLOCK] = (blocks @ self.direct + states @ self.seen).ravel()
        (p, q), (r, s) = self.step.tolist()
        c, d = self.into.tolist()
        for i, w in enumerate(x[n * self.BLOCK :].tolist(), n * self.BLOCK):
            out[i] = self.first * w + u
            u, v = p * u + q * v + c * w, r * u + s * v + d * w
        self.state = np.array([u, v])
        return np.clip(out, -1.0, 1.0) if self.hold else out


class Envelope:
    """One-pole follower with its own coefficient for rising and for falling input."""

    def __init__(self, attack: float, release: float, start: float = 0.0) -> None:
        self.attack, self.release, self.level = attack, release, start

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, p, attack, release = [], self.level, self.attack, self.release
        for v in x.tolist():
            c = attack if v > p else release
            p = c * p + (1.0 - c) * v
            out.append(p)
        self.level = p
        return np.array(out)


class Gate:
    """Gain opens where the envelope passes the threshold and for ``hold_ms`` after, smoothed from 1."""

    def __init__(
        self, rate: int = RATE, threshold_db: float = -65.0, attack_ms: float = 1, release_ms: float = 150, hold_ms: float = 50
    ) -> None:
        attack, release = constant(attack_ms, rate), constant(release_ms, rate)
        self.level, self.gain = Envelope(attack, release), Envelope(attack, release, 1.0)
        self.threshold, self.hold = 10 ** (threshold_db / 20), int(rate * hold_ms / 1000)
        self.since = 1 << 60  # samples since it was open

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        place = np.arange(len(x))
        last = np.maximum.accumulate(np.where(self.level(np.abs(x)) > self.threshold, place, -1))
        since = np.where(last >= 0, place - last, place + 1 + self.since)
        self.since = int(min(since[-1], 1 << 60))
        return x * self.gain((since <= self.hold).astype(float))


class Compressor:
    """Downward compression; the gain is smoothed from 0, so the start fades in. Peaks are not limited here."""

    def __init__(self, mode: str = "speech", rate: int = RATE) -> None:
        threshold_db, self.ratio, makeup_db, attack_ms, release_ms = COMPRESSOR[mode]
        self.threshold, self.makeup = 10 ** (threshold_db / 20), 10 ** (makeup_db / 20)
        self.level = Envelope(constant(attack_ms, rate), constant(release_ms, rate))
        c = constant(release_ms, rate)
        self.smooth = Section([1.0 - c, 0.0, 0.0], [1.0, -c, 0.0])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        level = self.level(np.abs(x))
        gain = np.where(level > self.threshold, (self.threshold + (level - self.threshold) / self.ratio) / (level + 1e-12), 1.0)
        return x * np.clip(self.smooth(gain), 0.0, 1.0) * self.makeup


def biquad(kind: str, frequency: float, gain_db: float, q: float, rate: int = RATE) -> Section:
    """A second-order section: high or low pass, or a peak; output held within -1 and 1."""
    w = 2 * math.pi * frequency / rate
    alpha, cos = math.sin(w) / (2 * q), math.cos(w)
    if kind == "peak":
        a = 10 ** (gain_db / 40)
        b, d = (1 + alpha * a, -2 * cos, 1 - alpha * a), (1 + alpha / a, -2 * cos, 1 - alpha / a)
    else:
        s = 1 + cos if kind == "high" else 1 - cos
        b = (s / 2, -s if kind == "high" else s, s / 2)
        d = (1 + alpha, -2 * cos, 1 - alpha)
    return Section([v / d[0] for v in b], [v / d[0] for v in d], True)


def equaliser(bands: tuple = SPEECH_EQ, rate: int = RATE) -> list[Section]:
    """The sections of the bands that lie below half the rate."""
    return [biquad(kind, f, gain_db, q, rate) for kind, f, gain_db, q in bands if f < rate / 2]


def k_weighting(rate: int = RATE) -> list[Section]:
    """The two sections of the loudness measure."""
    shelf_w = 2 * math.pi * 1500.0 / rate
    amp, alpha, cos = 10 ** (4.0 / 40), math.sin(shelf_w) / (2 / math.sqrt(2)), math.cos(shelf_w)
    root = 2 * math.sqrt(amp) * alpha
    b = [amp * ((amp + 1) + (amp - 1) * cos + root), -2 * amp * ((amp - 1) + (amp + 1) * cos), amp * ((amp + 1) + (amp - 1) * cos - root)]
    a = [(amp + 1) - (amp - 1) * cos + root, 2 * ((amp - 1) - (amp + 1) * cos), (amp + 1) - (amp - 1) * cos - root]
    w = 2 * math.pi * 38.0 / rate
    alpha, cos = math.sin(w) / (2 * 0.5), math.cos(w)
    d = [1 + alpha, -2 * cos, 1 - alpha]
    return [
        Section([v / a[0] for v in b], [v / a[0] for v in a]),
        Section([(1 + cos) / 2 / d[0], -(1 + cos) / d[0], (1 + cos) / 2 / d[0]], [v / d[0] for v in d]),
    ]


class Resampler:
    """Windowed-sinc resampling that holds the samples its next outputs reach back to; the same rate changes nothing."""

    def __init__(self, rate: int, target: int, width: int = 6, rolloff: float = 0.99) -> None:
        g = math.gcd(rate, target)
        self.up, self.down, self.width = target // g, rate // g, width
        self.cut = min(1.0, self.up / self.down) * rolloff
        self.half = width / self.cut
        self.taps = int(2 * self.half) + 2
        self.kept, self.begin, self.seen, self.next = np.empty(0), 0, 0, 0

    def _first(self, j: np.ndarray) -> np.ndarray:
        return np.floor(j * self.down / self.up - self.half).astype(np.int64)

    def _outputs(self, stop: int) -> np.ndarray:
        j = np.arange(self.next, stop)
        centre, first, out = j * self.down / self.up, self._first(j), np.zeros(len(j))
        for k in range(self.taps):
            at = first + k
            t = (at - centre) * self.cut
            weight = np.where(np.abs(t) < self.width, np.sinc(t) * np.cos(np.pi * t / self.width / 2) ** 2 * self.cut, 0.0)
            inside = (at >= 0) & (at < self.seen)
            out += np.where(inside, weight * self.kept[np.clip(at - self.begin, 0, max(len(self.kept) - 1, 0))], 0.0) if len(self.kept) else 0.0
        self.next = max(stop, self.next)
        least = max(0, int(self._first(np.array([self.next]))[0]))
        if least > self.begin:
            self.kept, self.begin = self.kept[least - self.begin :], least
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.up == self.down:
            return x
        self.kept, self.seen = np.concatenate([self.kept, x]), self.seen + len(x)
        # the outputs whose last tap has come: first + taps - 1 < seen
        ready = int((self.seen - self.taps + self.half) * self.up / self.down)
        ready = max(ready, self.next)
        while ready > self.next and self._first(np.array([ready - 1]))[0] + self.taps > self.seen:
            ready -= 1
        return self._outputs(ready)

    def flush(self) -> np.ndarray:
        return np.empty(0) if self.up == self.down else self._outputs(-(-self.seen * self.up // self.down))


def limit_peak(x: np.ndarray, ceiling: float = 0.99) -> np.ndarray:
    top = np.abs(x).max(initial=0.0)
    return x * (ceiling / top) if top > ceiling else x


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """A short signal at another rate."""
    if rate == target or not len(x):
        return x
    turned = Resampler(rate, target)
    return np.concatenate([turned(x), turned.flush()])


def speech_mask(begin: int, n: int, spans: list[tuple[int, int]], rate: int = RATE, fade_ms: float = 20) -> np.ndarray:
    """The mask of the samples from ``begin``: 1 within the spans, 0 outside, with half-cosine fades inside each span's ends;
    overlaps take the greater."""
    mask, fade = np.zeros(n), int(rate * fade_ms / 1000)
    for start, end in spans:
        a, b = max(start, begin), min(end, begin + n)
        if b <= a:
            continue
        rise = min(fade, end - start)
        fall = end - max(end - fade, start + rise)
        place, part = np.arange(a, b) - start, np.ones(b - a)
        if rise > 0:
            up = place < rise
            part[up] = (1 - np.cos(np.linspace(0, 1, rise)[place[up]] * np.pi)) / 2
        if fall > 0:
            down = place >= end - start - fall
            part[down] = (1 + np.cos(np.linspace(0, 1, fall)[place[down] - (end - start - fall)] * np.pi)) / 2
        at = slice(a - begin, b - begin)
        mask[at] = np.maximum(mask[at], part)
    return mask


def pitch_track(x: np.ndarray, rate: int, low: float = 50.0, high: float = 600.0, frame_ms: float = 30.0) -> np.ndarray:
    """Fundamental frequency of each frame by its normalised autocorrelation's best lag; 0 where nothing repeats."""
    size = int(rate * frame_ms / 1000)
    least, most = max(1, int(rate / high)), int(rate / low)
    out = []
    for start in range(0, max(0, len(x) - size - most), max(1, size // 2)):
        frame = x[start : start + size + most]
        head = frame[:size]
        energy = head @ head
        if energy < 1e-9:
            out.append(0.0)
            continue
        lags = np.arange(least, most)
        later = np.lib.stride_tricks.sliding_window_view(frame, size)[least:most]
        match = later @ head / np.sqrt(energy * np.einsum("ij,ij->i", later, later) + 1e-12)
        around = np.pad(match, 1, constant_values=-1.0)
        tops = (match >= around[:-2]) & (match >= around[2:])
        good = np.flatnonzero(tops & (match >= 0.95 * match.max()))
        out.append(rate / float(lags[good[0]]) if match.max() > 0.5 else 0.0)
    return np.array(out)


class Splice:
    """``new`` in place of the samples from start to end of a track of ``total``, padded or sped up to fit, with 20 ms linear
    cross-fades at both joins."""

    def __init__(self, new: np.ndarray, start: int, end: int, total: int, rate: int = RATE) -> None:
        end = min(end, total)
        start = min(start, end)
        room = end - start
        if len(new) > room:
            new = resample(new, int(rate * len(new) / max(room, 1)), rate)[:room]
        new = np.concatenate([new, np.zeros(room - len(new))])
        n = min(int(0.02 * rate), start, room)
        rise = np.linspace(0.0, 1.0, n) if n > 0 else np.empty(0)
        self.head, new, self.fade = new[:n] * rise, new[n:], n
        tail = n if n > 0 and total - end >= n and len(new) >= n else 0
        self.tail, self.middle = new[len(new) - tail :] * rise[::-1][:tail], new[: len(new) - tail]
        self.down, self.up = rise[::-1], rise[:tail]
        self.start, self.end, self.at, self.told = start, end, 0, False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        begin, self.at = self.at, self.at + len(x)
        place, x = begin + np.arange(len(x)), x.astype(float).copy()
        before = (place >= self.start - self.fade) & (place < self.start)
        k = place[before] - (self.start - self.fade)
        x[before] = x[before] * self.down[k] + self.head[k]
        after = (place >= self.end) & (place < self.end + len(self.tail))
        k = place[after] - self.end
        x[after] = x[after] * self.up[k] + self.tail[k]
        parts = [x[place < self.start]]
        if not self.told and self.at >= self.start:
            parts.append(self.middle)
            self.told = True
        return np.concatenate([*parts, x[place >= self.end]])
