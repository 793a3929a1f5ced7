"""Repeated word windows by an FM-index per shard.

A window is WINDOW consecutive words of one document; it is repeated if the same words start earlier: in a smaller
doc_id, or in the same document further left. Words under a repeated window are removed.

1. Each document is cut into segments: runs of windows with the same minimizer, the least hash of their GRAM-word
   grams. Equal windows have equal minimizers, so windows can only repeat among segments of one minimizer.
2. Minimizers that stand once in the corpus are done with. Equal segments of the others collapse to their first occurrence;
   later ones are repeated as a whole.
3. The remaining, distinct segments are dealt to shards by minimizer; where one minimizer has very many, by window. Each
   shard builds a compressed FM-index over its segments (symbols are grams, every GRAM-th one, so a window is
   WINDOW / GRAM symbols), streams its documents' segments through it by backward search, and reports each window whose
   range of suffixes has an earlier place.

Grams are told apart by 48 bits of a hash in the index and by 64 elsewhere. Null texts have no words; texts shorter than
a window keep all their words; rows that repeat a doc_id count as one document, equal places of which don't remove each
other; null ids are the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.fmindex import FMIndex
from brindle.llm.text import alone
from brindle.staging import bounded_batches, stage

WINDOW, GRAM = 20, 5
#: Symbols that a shard's index should hold, and distinct segments from which a minimizer is dealt by window.
SHARD_SYMBOLS, HOT_SEGMENTS = 400_000, 5_000
#: Documents with removals, and their intervals, up to which these are broadcast; more are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_INTERVALS = 400_000, 2_000_000
REMEMBERED = 400_000
_LEAST = -(1 << 63)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KNOWN: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def grams(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the GRAM-word grams at each place."""
    known = alone(_KNOWN)
    found = list(map(known.get, words))
    if None in found:
        if len(known) > REMEMBERED:
            known.clear()
        for k, v in enumerate(found):
            if v is None:
                found[k] = xxhash.xxh64_intdigest(words[k])
                if len(words[k]) <= 64:
                    known[words[k]] = found[k]
    h = np.array(found, np.uint64)
    n = len(h) - GRAM + 1
    out = h[:n].copy()
    for j in range(1, GRAM):
        out = _mix(out * _A + h[j : j + n])
    return _mix(out)


def segments(g: np.ndarray) -> tuple[np.ndarray, ...]:
    """A document's segments, from its grams: minimizer, first window, number of windows, content hash, and whether
    the document has the minimizer more than once (then windows may repeat even within the segment)."""
    span = WINDOW - GRAM + 1  # grams of a window
    least, width = g, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(start, len(least)))
    # content: the sum of gram * ODD ** place, moved to place 0
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(g), _A))])
    back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(g), np.uint64(pow(int(_A), -1, 1 << 64))))])
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * power[:-1])])
    content = (prefix[start + count + span - 1] - prefix[start]) * back[start]
    ordered = np.sort(g)
    again = np.searchsorted(ordered, least[start], "right") - np.searchsorted(ordered, least[start]) > 1
    return least[start], start, count, _mix(content + count.astype(np.uint64)), again


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text) -> (minimizer, content, doc_id, mark, start, windows, again)."""
    for b in batches:
        parts, sizes = [], []
        for t in b.column(2):
            w = words_of(t.as_py())
            if len(w) < WINDOW:
                sizes.append(0)
                continue
            parts.append(segments(grams(w)))
            sizes.append(len(parts[-1][0]))
        if not parts:
            continue
        least, start, count, content, again = (np.concatenate(x) for x in zip(*parts))
        yield pa.RecordBatch.from_pydict(
            {
                "minimizer": least.view(np.int64),
                "content": content.view(np.int64),
                "doc_id": np.repeat(b.column(0).to_numpy(), sizes),
                "mark": np.repeat(b.column(1).to_numpy(), sizes),
                "start": start.astype(np.int32),
                "windows": count.astype(np.int32),
                "again": again,
            }
        )


_SEGMENT = "minimizer long, content long, doc_id long, mark long, start int, windows int, again boolean"
_PIECE = "shard int, doc_id long, mark long, start int, grams binary"


def _cut_pieces(shards: int):
    """(doc_id, mark, text, found) -> the text of the found segments as gram symbols, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, mark, text, found in zip(*(c.to_pylist() for c in b.columns)):
                g = grams(words_of(text))
                six = g.view(np.uint16).reshape(-1, 4)[:, :3]
                for x in found:
                    s, n = x["start"], x["windows"]
                    if x["hot"]:  # each window for itself
                        w = g[s : s + n + WINDOW - GRAM]
                        key = w[:n].copy()
                        for k in range(GRAM, WINDOW, GRAM):
                            key = _mix(key * _A + w[k : k + n])
                        for i, shard in enumerate((key % np.uint64(shards)).tolist()):
                            rows.append((shard, doc, mark, s + i, six[s + i : s + i + WINDOW - GRAM + 1].tobytes()))
                    else:
                        shard = int(_mix(np.array([x["minimizer"]], np.int64).view(np.uint64))[0] % np.uint64(shards))
                        rows.append((shard, doc, mark, s, six[s : s + n + WINDOW - GRAM].tobytes()))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "doc_id", "mark", "start", "grams"]
            )

    return run


def search_shard(pieces: pa.Table) -> pa.Table:
    """The word intervals (doc_id, mark, begin, end) of a shard's pieces that lie under windows with an earlier place."""
    docs, marks, starts = (pieces[c].to_numpy() for c in ("doc_id", "mark", "start"))
    blobs = pieces["grams"].to_pylist()
    sizes = np.array([len(x) // 6 for x in blobs])
    raw = np.zeros((int(sizes.sum()), 4), np.uint16)
    raw[:, :3] = np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, 3)
    del blobs
    values, symbols = np.unique(raw.view(np.uint64).reshape(-1), return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    sigma = len(values) + 1
    piece = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # the text: per piece and phase the symbols at every GRAM-th place, then a separator
    order = np.lexsort((offset, offset % GRAM, piece))
    group = piece[order] * GRAM + offset[order] % GRAM
    breaks = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    place = np.arange(len(order)) + breaks
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = symbols[order]
    _, doc_rank = np.unique(docs, return_inverse=True)
    key = np.full(len(text), np.iinfo(np.int64).max)
    key[place] = doc_rank[piece[order]] * (1 << 32) + starts[piece[order]] + offset[order]
    index = FMIndex(text, sigma, WINDOW // GRAM)
    least = index.least(key)
    window = offset <= sizes[piece] - (WINDOW - GRAM + 1)
    at = np.flatnonzero(window)
    repeated = np.zeros(len(at), bool)
    for k in range(0, len(at), 65_536):
        own = at[k : k + 65_536]
        low, high = index.search(np.stack([symbols[own + j] for j in range(0, WINDOW, GRAM)], axis=1))
        mine = doc_rank[piece[own]] * (1 << 32) + starts[piece[own]] + offset[own]
        repeated[k : k + 65_536] = (high > low) & (least[np.minimum(low, len(least) - 1)] < mine)
    hits = at[repeated]
    p, begin = piece[hits], starts[piece[hits]] + offset[hits]
    new = np.ones(len(hits), bool)
    new[1:] = (p[1:] != p[:-1]) | (begin[1:] > begin[:-1] + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hits)) - 1 if len(hits) else first
    return pa.table(
        {
            "doc_id": docs[p[first]],
            "mark": marks[p[first]],
            "begin": begin[first].astype(np.int32),
            "end": (begin[last] + WINDOW).astype(np.int32),
        }
    )


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, begin, end): word intervals to remove, of ``docs`` (doc_id, mark, text). They may overlap."""
    found = stage(docs.mapInArrow(_find_segments, _SEGMENT), "segments")
    again = found.groupBy("minimizer").agg(F.count("*").alias("k"), F.max("again").alias("again"))
    again = again.filter("k > 1 OR again").select("minimizer")
    common = stage(found.drop("again").join(again, "minimizer"), "common")
    distinct = stage(
        common.groupBy("minimizer", "content", "windows").agg(
            F.min(F.struct("doc_id", "start", "mark")).alias("first")
        ),
        "distinct",
    )
    late = (
        common.join(distinct, ["minimizer", "content", "windows"])
        .filter(F.struct("doc_id", "start") > F.struct("first.doc_id", "first.start"))
        .select("doc_id", "mark", F.col("start").alias("begin"), F.expr(f"start + windows + {WINDOW - 1}").alias("end"))
    )
    hot = distinct.groupBy("minimizer").agg(F.count("*").alias("k")).filter(F.col("k") > HOT_SEGMENTS)
    hot = hot.select("minimizer", F.lit(True).alias("hot"))
    symbols = distinct.agg(F.coalesce(F.sum(F.col("windows") + (WINDOW - GRAM)), F.lit(0))).first()[0]
    shards = max(1, -(-int(symbols) // SHARD_SYMBOLS))
    wanted = (
        distinct.join(hot, "minimizer", "left")
        .groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"))
        .agg(
            F.collect_list(
                F.struct(
                    "minimizer",
                    F.col("first.start").alias("start"),
                    "windows",
                    F.coalesce("hot", F.lit(False)).alias("hot"),
                )
            ).alias("found")
        )
    )
    pieces = docs.join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "text", "found")
    pieces = pieces.mapInArrow(_cut_pieces(shards), _PIECE)
    early = pieces.groupBy("shard").applyInArrow(search_shard, "doc_id long, mark long, begin int, end int")
    return early.unionByName(late)


def _marked(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        F.col(text).alias("text"),
        *more,
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's intervals, those that overlap or touch as one."""
    for b in batches:
        begins, ends = [], []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            first, last = np.sort(np.array(x)), np.sort(np.array(y))
            new = np.concatenate([[True], first[1:] > last[:-1]])
            begins.append(first[new].tolist())
            ends.append(last[np.append(new[1:], True)].tolist())
        lists = [pa.array(v, pa.list_(pa.int32())) for v in (begins, ends)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "mark", "begins", "ends"])


def _with_removals(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    """doc_id, mark, text, ``more`` and the lists ``begins`` and ``ends`` (null where nothing is removed)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = _marked(docs, doc_id, text)
    found = repeated_intervals(marked).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("begin", "end")).alias("x"))
    cut = found.select("doc_id", "mark", F.col("x.begin").alias("begins"), F.col("x.end").alias("ends"))
    cut = stage(cut.mapInArrow(_merge, "doc_id long, mark long, begins array<int>, ends array<int>"), "cuts")
    n, intervals = cut.agg(F.count("*"), F.coalesce(F.sum(F.size("begins")), F.lit(0))).first()
    small = n <= BROADCAST_DOCS and intervals <= BROADCAST_INTERVALS
    return _marked(docs, doc_id, text, *more).join(F.broadcast(cut) if small else cut, ["doc_id", "mark"], "left")


def _kept(text: str | None, begins: list | None, ends: list | None) -> tuple[list[bytes], int]:
    """The kept words and how many are removed."""
    words = words_of(text)
    if not begins:
        return words, 0
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    gone = np.cumsum(change)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t, begins, ends in zip(*(c.to_pylist() for c in b.columns)):
                words, removed = _kept(t, begins, ends)
                digest = hashlib.sha256(b" ".join(words)).hexdigest()
                out.append((None if d == _LEAST else d, len(words) + removed, removed, digest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    rows = _with_removals(docs, doc_id, text).select("doc_id", "text", "begins", "ends")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words under repeated windows; texts that lose none stay as they are, to the character."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for b in batches:
            texts = []
            for t, begins, ends in zip(*(b.column(k).to_pylist() for k in (at, len(names), len(names) + 1))):
                words, removed = _kept(t, begins, ends)
                texts.append(b" ".join(words).decode("utf-8") if removed else t)
            columns = [*b.columns[: len(names)]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    row = F.struct(*[F.col(c) for c in names]).alias("row")
    rows = _with_removals(docs, doc_id, text, row)
    rows = rows.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], F.col("begins").alias("_begins"), F.col("ends").alias("_ends")
    )
    return rows.mapInArrow(run, docs.schema)
