"""Signal measurements and simple processing on ``array`` columns of samples, as column expressions.

A null or empty array has peak, power and clip share 0. Sums run from left to right in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CEILING, TARGET_LUFS, TRUE_PEAK_DB = 0.99, -16.0, -1.0


def doubles(x: Column) -> Column:
    return F.transform(F.coalesce(x, F.array().cast("array<double>")), lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    """Mean of an array; 0 for an empty one."""
    return F.when(F.size(x) > 0, total(x) / F.size(x)).otherwise(F.lit(0.0))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def mean_square(x: Column) -> Column:
    return mean(F.transform(x, lambda v: v * v))


def rms(x: Column) -> Column:
    return F.sqrt(mean_square(x))


def clip_share(x: Column) -> Column:
    """Share of samples beyond the ceiling."""
    return mean(F.transform(x, lambda v: F.when(F.abs(v) > CEILING, 1.0).otherwise(0.0)))


def clipped(x: Column) -> Column:
    return clip_share(x) > 0.001


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(x: Column) -> Column:
    return F.log10(x + 1e-8) * 20


def match_length(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def snr_db(raw: Column, enhanced: Column) -> Column:
    """Signal over difference, in dB, over the common prefix."""
    r, e = match_length(raw, enhanced)
    noise = mean_square(F.zip_with(r, e, lambda x, y: x - y)) + 1e-10
    return F.log10(F.greatest(mean_square(e), F.lit(1e-10)) / noise) * 10


def quality(snr: Column, clips: Column, lufs: Column) -> Column:
    """Score 0 to 1 from SNR, loudness distance and clipping, three decimals."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (snr + 5) / 40))
    loud = 1.0 - F.least(F.lit(1.0), F.abs(lufs - TARGET_LUFS) / 20)
    return F.round(F.greatest(F.lit(0.0), s * 0.6 + loud * 0.4 - F.when(clips, 0.3).otherwise(0.0)), 3)


def content_mode(drums: Column, bass: Column, other: Column, vocals: Column) -> Column:
    """music, podcast or speech, by the stems' RMS."""
    music = drums + bass + other
    power = music + vocals + 1e-10
    return (
        F.when(vocals < 1e-5, "music")
        .when(((drums + bass) / power > 0.4) & (vocals / power < 0.2), "music")
        .when((vocals / power > 0.3) & (music / power > 0.15), "podcast")
        .otherwise("speech")
    )


def time_constant(ms: float, rate: int) -> float:
    """One-pole coefficient of a time in milliseconds."""
    import math

    return math.exp(-1.0 / (rate * ms / 1000.0))


def envelope_end(x: Column, attack: float, release: float) -> Column:
    """Last value of the attack/release envelope that starts at 0."""

    def step(p: Column, v: Column) -> Column:
        c = F.when(v > p, F.lit(attack)).otherwise(F.lit(release))
        return c * p + (1 - c) * v

    return F.aggregate(x, F.lit(0.0), step)


def peak_normalise(x: Column, peak_db: float = TRUE_PEAK_DB) -> Column:
    """Scaled so that the peak is at ``peak_db``; silence stays."""
    p = peak(x)
    gain = F.when(p < 1e-8, F.lit(1.0)).otherwise(F.lit(10 ** (peak_db / 20)) / p)
    return F.transform(x, lambda v: v * gain)


def cosine_fade(n: Column) -> Column:
    """Rising half cosine of n points."""
    last = F.greatest(n - 1, F.lit(1))
    points = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    return F.transform(points, lambda k: (1 - F.cos(k / last * F.pi())) * 0.5)


def suppress(x: Column, mask: Column, floor: float = 0.08) -> Column:
    """Samples under a 0..1 mask, never below ``floor`` of their value."""
    a, m = match_length(x, mask)
    return F.zip_with(a, m, lambda v, g: v * (floor + g * (1 - floor)))


def strip_silence(x: Column, start: Column, end: Column, fade: int) -> Column:
    """Samples from ``start`` to ``end``, faded at both ends if long enough; without a span unchanged."""
    import math

    a, b = F.greatest(start, F.lit(0)), F.least(end, F.size(x))
    cut = F.slice(x, a + 1, F.greatest(b - a, F.lit(0)))
    n = F.size(cut)
    step = math.pi / max(fade - 1, 1)
    gain = lambda k: F.when(k < fade, (1 - F.cos(k * step)) * 0.5).otherwise(F.lit(1.0))
    faded = F.transform(cut, lambda v, k: v * gain(k) * gain(n - 1 - k))
    return F.when(start.isNull() | end.isNull() | (b <= a), x).when(n > 2 * fade, faded).otherwise(cut)


def lower_median(x: Column) -> Column:
    """The middle value, of an even number the lower one."""
    s = F.array_sort(x)
    return F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))


def sample_std(x: Column) -> Column:
    m = mean(x)
    squares = F.transform(x, lambda v: (v - m) * (v - m))
    return F.when(F.size(x) > 1, F.sqrt(total(squares) / (F.size(x) - 1))).otherwise(F.lit(0.0))


def voice(f0: Column, seconds: Column) -> Column:
    """Voice label from the pitch track of a segment: sex by the median, accent by rise, spread and range."""
    v = F.filter(f0, lambda x: x > 50)
    n = F.size(v)
    head = F.slice(v, 1, F.greatest(F.floor(n * 0.3).cast("int"), F.lit(1)))
    tail = F.slice(v, F.floor(n * 0.7).cast("int") + 1, n)
    rise = F.when(n > 10, mean(tail) / (mean(head) + 1e-8)).otherwise(F.lit(1.0))
    spread = sample_std(v) / (mean(v) + 1e-8)
    wide = F.array_max(v) - F.array_min(v)
    accent = F.when(rise > 1.08, "au").when((spread > 0.25) | (wide > 120), "uk").otherwise("us")
    sex = F.when(lower_median(v) >= 165, "female").otherwise("male")
    return F.when((seconds < 0.1) | (n < 5), "male_us").otherwise(F.concat_ws("_", sex, accent))
