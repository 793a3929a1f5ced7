"""Document fingerprints from closed syncmers, matched by position.

A K-mer of code points is an anchor if the least of the hashes of its inner S-mers is its first's or its last's. That
depends on the K-mer alone, so equal passages have equal anchors wherever they stand. A fingerprint holds the anchors
whose hash is in the lowest SHARE of all hashes, so it grows with its text and any long passage has some of them, and at
least the LEAST anchors with the lowest hashes: hash and position, eight hexadecimal digits each, in the order of the text.

Two fingerprints are compared over the hashes that both would have kept. Equal anchors (the n-th of a hash with the
n-th) match if they stand at the same place or if the next match before or after them has the same offset, both within
TOLERANCE: so passages match that were moved as a whole, and stray equal K-mers don't. The likeness is the share of
matching anchors among all of both.

Texts shorter than K have one anchor, their own hash; longer ones without a closed syncmer have their least K-mer; null
and empty texts have none and an empty fingerprint, which is like another empty one (1) and unlike any other (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import wider
from brindle.staging import bounded_batches, setting

K, S, LEAST, TOLERANCE = 16, 6, 64, 24
#: Anchors below this hash are always kept: a quarter of them.
SHARE = 1 << 30
#: Bytes of text in a part, and how many parts there may be at most: beyond it they grow.
PART_BYTES, PARTS = 16 << 20, 50_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NULL = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < K:
        own = [xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))] if n else []
        return np.zeros(len(own), np.int64), np.array(own, np.uint32)
    inner = codes[: n - S + 1].copy()
    for j in range(1, S):
        inner *= _STEP
        inner += codes[j : n - S + 1 + j]
    inner = _mixed(inner)
    width = K - S + 1
    least, span = inner, 1  # least of ``span`` neighbours
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[:-rest], least[rest:])
    first, last = inner[: n - K + 1], inner[width - 1 :]
    at = np.flatnonzero((first == least) | (last == least))
    none = not len(at)
    if none:
        at = np.arange(n - K + 1)
    whole = _mixed(inner[at] * _STEP + inner[at + (width // 2)]) * _STEP + inner[at + width - 1]
    h = (_mixed(whole) >> np.uint64(32)).astype(np.uint32)
    if none:
        at, h = at[[h.argmin()]], h[[h.argmin()]]
    return at, h


def sketch(text: str) -> np.ndarray:
    """[anchor, (hash, position)] of the kept anchors, by position, as unsigned 32-bit integers."""
    at, h = anchors(text)
    values = np.unique(h)
    limit = max(SHARE - 1, int(values[min(LEAST, len(values)) - 1])) if len(values) else 0
    kept = h <= limit
    return np.column_stack([h[kept], at[kept].astype(np.uint32)])


def written(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    """The sketch that ``written`` wrote."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").reshape(-1, 2).astype(np.uint32)


def _limit(found: np.ndarray) -> int:
    """The greatest hash that the fingerprint would have kept; all of them if it has fewer than LEAST."""
    values = np.unique(found[:, 0])
    return (1 << 32) - 1 if len(values) < LEAST else max(SHARE - 1, int(values[-1]))


def _keyed(found: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (hash, how many of it stand before) and positions of the anchors up to the limit."""
    found = found[found[:, 0] <= limit]
    order = np.argsort(found[:, 0], kind="stable")
    h = found[order, 0].astype(np.uint64)
    first = np.searchsorted(h, h)
    return (h << np.uint64(32)) | (np.arange(len(h)) - first).astype(np.uint64), found[order, 1].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of anchors that match in place or in runs, among all of both sketches."""
    if not len(a) and not len(b):
        return 1.0
    limit = min(_limit(a), _limit(b))
    (key_a, at_a), (key_b, at_b) = _keyed(a, limit), _keyed(b, limit)
    _, i, k = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    order = np.argsort(at_a[i], kind="stable")
    offset = at_b[k][order] - at_a[i][order]
    near = np.abs(np.diff(offset)) <= TOLERANCE
    match = np.abs(offset) <= TOLERANCE
    match[1:] |= near
    match[:-1] |= near
    n = int(match.sum())
    return n / (len(key_a) + len(key_b) - n)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the written sketch of each whole text."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c != "fingerprint"])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([written(sketch(t or "")) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "fingerprint"])

    return kept.mapInArrow(run, wider(kept.schema, fingerprint="string"))


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(doc_id: int, own: tuple[str, np.ndarray], following: tuple[str, np.ndarray]) -> tuple:
    edited = edited_text(own[0], following[0])
    mark = sketch(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(own[1], mark), likeness(own[1], following[1])
    return (doc_id if doc_id != _NULL else None, len(own[0]), digest, written(own[1]), written(mark), *near)


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by descending doc_id.

    Documents are dealt to parts by ranges of doc_id, about PART_BYTES of text each, each part also gets the first
    document of the next (the last part that of the first), and every part is read in order, one document at a time. The
    ranges' bounds and the parts' first ids, two numbers a part and PARTS parts at most, are all that reaches the
    driver. Null ids come last; documents of equal id stand in the order of their texts, and are read by one task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL)).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(setting(spark, "spark.sql.shuffle.partitions") or 200)
    parts = min(PARTS, max(least, -(-int(size) // PART_BYTES)))
    cuts = rows.agg(
        F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 20 * parts)).alias("c")
    ).first()["c"]
    bounds = np.unique(np.array(cuts or [], np.int64))
    parts = len(bounds) + 1

    last = len(bounds)  # parts are numbered as they are read, by descending ids

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"part": last - np.searchsorted(bounds, ids), "doc_id": ids})

    firsts = (
        rows.select("doc_id").mapInArrow(part, "part long, doc_id long").groupBy("part").agg(F.max("doc_id").alias("m"))
    )
    found = sorted((r["part"], r["m"]) for r in firsts.collect())
    ahead = {m: found[k - 1][0] for k, (_, m) in enumerate(found)}  # a part's first document is needed one part earlier

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            own = last - np.searchsorted(bounds, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), b.column(0), b.column(1), pa.array(np.zeros(len(ids), np.int32))],
                names=["part", "doc_id", "text", "ahead"],
            )
            extra = [k for k, i in enumerate(ids.tolist()) if i in ahead]
            if extra:
                to = np.array([ahead[int(ids[k])] for k in extra], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), b.column(0).take(extra), b.column(1).take(extra), pa.array(np.ones(len(to), np.int32))],
                    names=["part", "doc_id", "text", "ahead"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(_RESULT)
        out: list[tuple] = []
        now, held, closed = None, None, True
        for b in batches:
            for p, i, t, a in zip(*(c.to_pylist() for c in b.columns)):
                if p != now:
                    now, held, closed = p, None, False
                if closed:
                    continue
                mark = (t, sketch(t))
                if held is not None:
                    out.append(_compared(*held, mark))
                held, closed = (i, mark), bool(a)
            if len(out) >= 256:
                yield _batch(out, names)
                out = []
        yield _batch(out, names)

    dealt = rows.mapInArrow(deal, "part long, doc_id long, text string, ahead int")
    ordered = dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions(
        "part", "ahead", F.desc("doc_id"), "text"
    )
    return ordered.mapInArrow(run, _RESULT)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(",")]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
