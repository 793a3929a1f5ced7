"""Long signals as rows (key, frame, samples): filters that carry their state, mixing, loudness and peaks.

A signal of any length is cut into frames of ``FRAME`` samples. A recursive filter takes a track's frames in order within one
partition and holds one frame and its state; measures are sums and greatest values of frames, joined back by track. No signal
is whole in one place unless ``from_frames`` is asked for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import dsp
from brindle.functions.signal import CEILING
from brindle.staging import stage

FRAME = 65_536
#: Frames that a mixing task holds before it passes their sums on.
HELD = 64


def to_frames(tracks: DataFrame, keys: list[str], samples: str = "samples", size: int = FRAME) -> DataFrame:
    """(keys, frame, samples) of whole signals; null and empty ones have one empty frame."""
    x = F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>"))
    n = F.greatest(F.ceil(F.size(x) / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(x, k * size + 1, size))
    rows = tracks.select(*keys, F.posexplode(cut).alias("frame", "samples"))
    return rows.withColumn("frame", F.col("frame").cast("long"))


def from_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, samples): signals put together again, for those who need them whole."""
    listed = F.array_sort(F.collect_list(F.struct("frame", "samples")))
    return frames.groupBy(*keys).agg(F.flatten(F.transform(listed, lambda f: f["samples"])).alias("samples"))


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _array(column: pa.ListArray, i: int) -> np.ndarray:
    value = column[i].values
    return np.empty(0) if value is None else value.to_numpy(zero_copy_only=False).astype(float)


def scanned(frames: DataFrame, keys: list[str], make: Callable[[dict], object], ddl: str, params: list[str] | None = None) -> DataFrame:
    """Rows (keys, then ``ddl``) that an object makes of each track's frames in order.

    ``make`` gets the track's ``params`` (columns that are the same in all its frames); the object's ``feed(samples)`` and
    ``end()`` give lists of tuples. A partition holds one frame and one object at a time.
    """
    params = params or []
    named = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{named}, {ddl}" if ddl else named
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, size = to_arrow_schema(out), len(keys)
    rows = frames.select(*keys, "frame", "samples", *params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, worker = None, None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(*now, *f) for f in found], strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            held = [b.column(i).to_pylist() for i in range(size)]
            given = [b.column(size + 2 + i) for i in range(len(params))]
            for i in range(b.num_rows):
                key = tuple(c[i] for c in held)
                if worker is None or key != now:
                    if worker is not None:
                        yield batch(worker.end())
                    now, worker = key, make({p: c[i].as_py() for p, c in zip(params, given, strict=True)})
                found = worker.feed(_array(b.column(size + 1), i))
                if found:
                    yield batch(found)
        if worker is not None:
            yield batch(worker.end())

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "frame")
    return ordered.mapInArrow(run, out)


class _Reframed:
    """The output of filters in a row, cut anew into frames of one size."""

    def __init__(self, filters: list, size: int) -> None:
        self.filters, self.size, self.frame = filters, size, 0
        self.kept: list[np.ndarray] = []
        self.n = 0

    def _cut(self, last: bool) -> list[tuple]:
        out = []
        if self.n >= self.size or last:
            x = np.concatenate(self.kept) if self.kept else np.empty(0)
            while len(x) >= self.size or (last and (len(x) or not self.frame)):
                out.append((self.frame, x[: self.size].tolist()))
                x, self.frame = x[self.size :], self.frame + 1
            self.kept, self.n = [x], len(x)
        return out

    def _pass(self, x: np.ndarray, at: int) -> None:
        for f in self.filters[at:]:
            x = f(x)
        self.kept.append(x)
        self.n += len(x)

    def feed(self, x: np.ndarray) -> list[tuple]:
        self._pass(x, 0)
        return self._cut(False)

    def end(self) -> list[tuple]:
        for i, f in enumerate(self.filters):  # what a filter still holds goes through those after it
            rest = f.flush() if hasattr(f, "flush") else np.empty(0)
            if len(rest):
                self._pass(rest, i + 1)
        return self._cut(True)


def carried(
    frames: DataFrame, keys: list[str], make: Callable[[dict], list], params: list[str] | None = None, size: int = FRAME
) -> DataFrame:
    """(keys, frame, samples): each track through the filters that ``make`` gives for it, their state carried on.

    A filter is called with the samples of each frame and gives samples, fewer or more; its ``flush``, if it has one, gives
    those that it held back.
    """
    return scanned(frames, keys, lambda p: _Reframed(make(p), size), "frame long, samples array<double>", params)


# ---- measures ----------------------------------------------------------------------------------------------------------


def _abs_max(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def peaks(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak)."""
    return frames.groupBy(*keys).agg(F.max(_abs_max(F.col("samples"))).alias("peak"))


def scaled(frames: DataFrame, keys: list[str], factors: DataFrame) -> DataFrame:
    """Frames times their track's ``factor`` of (keys, factor)."""
    kept = [c for c in frames.columns if c != "samples"]
    joined = frames.join(factors, keys)
    return joined.select(*kept, F.transform("samples", lambda v: v * F.col("factor")).alias("samples"))


def limited(frames: DataFrame, keys: list[str], ceiling: float = CEILING) -> DataFrame:
    """Frames of tracks whose peak passes the ceiling are scaled down to it."""
    top = peaks(frames, keys).withColumn("factor", F.when(F.col("peak") > ceiling, F.lit(ceiling) / F.col("peak")).otherwise(1.0))
    return scaled(frames, keys, top.drop("peak"))


def mixed(frames: DataFrame, keys: list[str], mean: bool = False) -> DataFrame:
    """(keys, frame, samples): the sum of all frames of one place, each times its ``gain`` if there is such a column.

    Shorter ones end early; the ``mean`` is over those that are there. Sums are made before the shuffle as well, so that a
    recording of very many tracks arrives as a few frames a task.
    """
    gain = F.col("gain").cast("double") if "gain" in frames.columns else F.lit(1.0)
    rows = frames.select(*keys, "frame", F.transform("samples", lambda v: v * gain).alias("samples"))
    ones = F.transform("samples", lambda v: F.lit(1.0))
    rows = rows.withColumn("n", ones if mean else F.array().cast("array<double>"))
    schema, size = _arrow(rows), len(keys) + 1

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) < len(b):
            a, b = b.copy(), a
        a[: len(b)] += b
        return a

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [()] * size
            columns += [[v[i].tolist() for v in held.values()] for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(size)), strict=True))
            for i, key in enumerate(ids):
                x, n = _array(b.column(size), i), _array(b.column(size + 1), i)
                if key in held:
                    held[key] = add(held[key][0], x), add(held[key][1], n)
                    continue
                if len(held) >= HELD:
                    yield batch()
                    held.clear()
                held[key] = x, n
        yield batch()

    before = rows.mapInArrow(sums, rows.schema)
    met = before.repartition(*keys, "frame").sortWithinPartitions(*keys, "frame").mapInArrow(sums, rows.schema)
    x = F.zip_with("samples", "n", lambda v, n: v / n) if mean else F.col("samples")
    # A partition's frames come in order, so a frame that a full batch cut in two can only be the last one of it.
    return met.select(*keys, "frame", x.alias("samples"))


def _hop_sums(hop: int, rate: int) -> Callable[[dict], object]:
    class Sums:
        """Sums of squares of the weighted signal by hop, and of the raw one; a hop that goes on is held."""

        def __init__(self) -> None:
            self.filters = dsp.k_weighting(rate)
            self.at, self.sum = 0, 0.0

        def feed(self, x: np.ndarray) -> list[tuple]:
            y = x
            for f in self.filters:
                y = f(y)
            out, place = [], self.at
            raw = float(x @ x)
            ends = np.arange(hop - place % hop, len(y) + 1, hop)
            before = 0
            for e in ends:
                power = self.sum + float(y[before:e] @ y[before:e])
                out.append(((place + int(e)) // hop - 1, power, 0.0, 0))
                self.sum, before = 0.0, e
            self.sum += float(y[before:] @ y[before:])
            self.at += len(y)
            return [*out, (None, None, raw, len(x))]

        def end(self) -> list[tuple]:
            return []

    return lambda p: Sums()


def gated_loudness(powers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lufs) of block powers (keys, power): the mean over blocks of -70 LUFS and more and, of these, those within 10
    units of their own mean; -99 where no block is left."""
    level = lambda p: F.lit(-0.691) + F.log10(F.greatest(p, F.lit(1e-30))) * 10
    loud = powers.withColumn("_loud", level(F.col("power")) >= -70.0)
    gates = loud.groupBy(*keys).agg(F.avg(F.when(F.col("_loud"), F.col("power"))).alias("_mean"))
    gates = gates.select(*keys, (level(F.col("_mean")) - 10.0).alias("_gate"))
    kept = F.col("_loud") & (level(F.col("power")) > F.col("_gate"))
    means = loud.join(gates, keys).groupBy(*keys).agg(F.avg(F.when(kept, F.col("power"))).alias("_mean"))
    return means.select(*keys, F.when(F.col("_mean").isNull(), -99.0).otherwise(level(F.col("_mean"))).alias("lufs"))


def loudness(frames: DataFrame, keys: list[str], rate: int = dsp.RATE) -> DataFrame:
    """(keys, lufs, n): integrated loudness and length of each track, as ``dsp.loudness`` of the whole signal.

    Blocks of 400 ms are four sums of hops; the gates are two aggregations. A track shorter than a block has its RMS in dB.
    """
    block = int(0.4 * rate)
    hop = block // 4
    if hop * 4 != block:
        raise ValueError("400 ms must be a multiple of four samples")
    sums = stage(scanned(frames, keys, _hop_sums(hop, rate), "hop long, power double, raw double, n long"), "hops")  # read thrice
    whole = sums.groupBy(*keys).agg(F.sum("raw").alias("raw"), F.sum("n").alias("n"))
    hops = sums.filter("hop is not null")
    next_four = Window.partitionBy(*keys).orderBy("hop").rowsBetween(0, 3)
    blocks = hops.select(*keys, F.sum("power").over(next_four).alias("power"), F.count("*").over(next_four).alias("c"))
    told = gated_loudness(blocks.filter("c = 4").select(*keys, (F.col("power") / block).alias("power")), keys)
    short = F.when(F.col("n") == 0, -99.0).otherwise(F.log10(F.sqrt(F.col("raw") / F.col("n")) + 1e-8) * 20)
    joined = whole.join(told, keys, "left")
    return joined.select(*keys, F.when(F.col("n") < block, short).otherwise(F.coalesce("lufs", F.lit(-99.0))).alias("lufs"), "n")


class _Peak:
    """The greatest absolute value after fourfold oversampling, frame by frame."""

    def __init__(self, rate: int) -> None:
        self.more = dsp.Resampler(rate, 4 * rate)

    def feed(self, x: np.ndarray) -> list[tuple]:
        return [(float(np.abs(self.more(x)).max(initial=0.0)),)]

    def end(self) -> list[tuple]:
        return [(float(np.abs(self.more.flush()).max(initial=0.0)),)]


def true_peaks(frames: DataFrame, keys: list[str], rate: int = dsp.RATE) -> DataFrame:
    """(keys, peak): as ``dsp.true_peak`` of the whole signal."""
    return scanned(frames, keys, lambda p: _Peak(rate), "peak double").groupBy(*keys).agg(F.max("peak").alias("peak"))


def normalised(frames: DataFrame, keys: list[str], target: Column | float = -16.0, rate: int = dsp.RATE) -> DataFrame:
    """To the target loudness; short, silent or odd tracks to a peak of -1 dB; within half a unit as they are.

    ``target`` may be a column of ``frames`` that is the same in all frames of a track.
    """
    goal = frames.groupBy(*keys).agg(F.first(target if isinstance(target, Column) else F.lit(target)).alias("goal"))
    told = loudness(frames, keys, rate).join(peaks(frames, keys), keys).join(goal, keys)
    odd = (F.col("n") < rate // 2) | ~F.col("lufs").between(-70.0, 0.0)
    by_peak = F.when(F.col("peak") < 1e-8, 1.0).otherwise(F.lit(10 ** (-1 / 20)) / F.col("peak"))
    gain = F.pow(F.lit(10.0), (F.col("goal") - F.col("lufs")) / 20)
    held = F.when(F.col("peak") * gain > CEILING, F.lit(CEILING) / F.col("peak")).otherwise(gain)
    near = F.abs(F.col("lufs") - F.col("goal")) <= 0.5
    factor = F.when(odd, by_peak).when(near, 1.0).otherwise(held)
    return scaled(frames, keys, told.select(*keys, factor.alias("factor")))


def limited_true_peak(frames: DataFrame, keys: list[str], ceiling_db: float = -1.0, rate: int = dsp.RATE) -> DataFrame:
    ceiling = 10 ** (ceiling_db / 20)
    factor = F.when(F.col("peak") > ceiling, F.lit(ceiling) / F.col("peak")).otherwise(1.0)
    return scaled(frames, keys, true_peaks(frames, keys, rate).select(*keys, factor.alias("factor")))


def snr(raw: DataFrame, enhanced: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, snr_db): signal over difference over the common prefix of two sets of frames."""
    both = raw.select(*keys, "frame", F.col("samples").alias("r")).join(enhanced.select(*keys, "frame", F.col("samples").alias("e")), [*keys, "frame"])
    n = F.least(F.size("r"), F.size("e"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    square = lambda a: F.transform(a, lambda v: v * v)
    sums = both.select(
        *keys, n.alias("n"), total(square(F.slice("e", 1, n))).alias("signal"),
        total(square(F.zip_with(F.slice("r", 1, n), F.slice("e", 1, n), lambda a, b: a - b))).alias("noise"),
    )
    met = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("signal").alias("signal"), F.sum("noise").alias("noise"))
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return met.select(*keys, (F.log10(F.greatest(mean("signal"), F.lit(1e-10)) / (mean("noise") + 1e-10)) * 10).alias("snr_db"))


def clipped(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clipped): whether more than a thousandth of the samples is beyond the ceiling."""
    beyond = F.size(F.filter("samples", lambda v: F.abs(v) > CEILING))
    met = frames.groupBy(*keys).agg(F.sum(beyond).alias("a"), F.sum(F.size("samples")).alias("n"))
    return met.select(*keys, (F.col("a") > F.col("n") * 0.001).alias("clipped"))


# ---- speech ------------------------------------------------------------------------------------------------------------


class _Energy:
    """Spans whose pieces of ``frame_ms`` are louder than a threshold: a stand-in for a trained speech detector."""

    def __init__(self, rate: int, frame_ms: float, threshold_db: float) -> None:
        self.size = max(1, int(rate * frame_ms / 1000))
        self.least = threshold_db
        self.rest, self.at, self.since = np.empty(0), 0, None

    def feed(self, x: np.ndarray) -> list[tuple]:
        x = np.concatenate([self.rest, x])
        n = len(x) // self.size
        loud = 20 * np.log10(np.sqrt((x[: n * self.size].reshape(n, self.size) ** 2).mean(axis=1)) + 1e-8) > self.least if n else []
        out = []
        for k, on in enumerate(loud):
            place = self.at + k * self.size
            if on and self.since is None:
                self.since = place
            elif not on and self.since is not None:
                out.append((self.since, place))
                self.since = None
        self.rest, self.at = x[n * self.size :], self.at + n * self.size
        return out

    def end(self) -> list[tuple]:
        return [] if self.since is None else [(self.since, self.at)]


def energy_spans(
    frames: DataFrame, keys: list[str], rate: int = dsp.RATE, frame_ms: float = 30, threshold_db: float = -45.0
) -> DataFrame:
    """(keys, start, end) in samples."""
    return scanned(frames, keys, lambda p: _Energy(rate, frame_ms, threshold_db), "start long, end long")


def masked(frames: DataFrame, keys: list[str], spans: DataFrame, floor: float = 0.08, rate: int = dsp.RATE, size: int = FRAME) -> DataFrame:
    """Frames with what is outside the spans (keys, start, end) turned down to ``floor``, with 20 ms half-cosine fades inside.

    A frame meets the spans that reach into it; tracks without spans stay as they are.
    """
    places = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))
    near = spans.filter("end > start").select(*keys, F.struct("start", "end").alias("s"), F.explode(places).alias("frame"))
    near = near.groupBy(*keys, "frame").agg(F.collect_list("s").alias("spans"))
    some = spans.select(*keys).distinct().withColumn("some", F.lit(True))
    rows = frames.join(some, keys, "left").join(near, [*keys, "frame"], "left").select(*frames.columns, "some", "spans")
    schema, names = frames.schema, frames.columns
    at, frame = names.index("samples"), names.index("frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                x = _array(b.column(at), i)
                if b.column("some")[i].as_py():
                    begin = b.column(frame)[i].as_py() * size
                    found = [(s["start"], s["end"]) for s in b.column("spans")[i].as_py() or []]
                    x = x * (floor + (1 - floor) * dsp.speech_mask(begin, len(x), found, rate))
                out.append(x.tolist())
            yield b.select(names).set_column(at, "samples", pa.array(out, pa.list_(pa.float64())))

    return rows.mapInArrow(run, schema)


class _Strip:
    """Only what lies from ``start`` to ``end``, with half-cosine fades at both ends if there is room for them."""

    def __init__(self, start: int | None, end: int | None, fade: int) -> None:
        self.start, self.end, self.fade, self.at = start, end, fade, 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        begin, self.at = self.at, self.at + len(x)
        if self.start is None:
            return x
        a, b = max(self.start - begin, 0), min(self.end - begin, len(x))
        if b <= a:
            return np.empty(0)
        out, place = x[a:b].copy(), begin + a - self.start + np.arange(b - a)
        n = self.end - self.start
        if n > 2 * self.fade:
            ramp = (1 - np.cos(np.linspace(0, 1, self.fade) * math.pi)) / 2
            head, tail = place < self.fade, place >= n - self.fade
            out[head] *= ramp[place[head]]
            out[tail] *= ramp[n - 1 - place[tail]]
        return out


def strip(start: int | None, end: int | None, fade: int) -> Callable[[np.ndarray], np.ndarray]:
    """A filter for ``carried``; without a start it changes nothing."""
    return _Strip(start, end, fade)
