"""Language-model scores by a class-based bigram model with exchange clustering.

Words of MIN_COUNT tokens or more are sorted into classes so as to raise the class bigrams' likelihood: the CORE most
frequent ones by rounds of exchanges, all others by one exchange each, into the class that gains most, the core staying
as it is. The number of classes grows with the fourth root of the tokens. Rarer words belong to fixed classes by their
endings. A token's probability is

    SHARE * P(class | previous token's class) * P(word | class) + (1 - SHARE) * (n + 1) / (N + V + 1)

with n the word's count, transitions smoothed towards the classes' own frequencies and, in the ending classes, emissions
(n + 1) / (N_class + V_class + 1), so that an unknown word of each ending has a share. Words are lower-cased (A-Z) and
told apart by 64-bit hashes; an end token closes each text and precedes its first word.

Texts are read once, into staged blocks of about BLOCK tokens: a block's distinct words and codes into them. Everything
after that works on blocks. Counts and classes of the whole vocabulary are a staged table that is joined by word; only
the LISTED most frequent words and the class bigrams reach driver and tasks, all of bounded size. Keys of the join are
other words, so none is hot.

A null text is empty (its end token alone is scored). With no training text the model is the base model, which gives
probability 1 to the one unknown word. Repeated rows are separate documents, and extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.staging import bounded_batches, stage, unstage

CORE, LISTED, MIN_COUNT = 8192, 1 << 17, 5
#: Turns of exchange in all, turns in which each core word moves once, and words that move one after the other.
ROUNDS, TURNS, GROUP = 8, 4, 1024
#: Classes with less than this part of the mean take no words from beyond the core.
SMALL = 8
#: Classes that exchange fills: at least and at most.
FEWEST, MOST = 32, 190
SHARE, PULL = 0.95, 2.0
#: Tokens of a block, and words that a Python worker remembers before it empties its table.
BLOCK, HELD = 1 << 18, 600_000
#: Bits of a sieve of words, a table of fixed size: the fuller it is, the more words pass it that needn't.
SIEVE = 1 << 25
#: Neighbours of one word that go to one task; listed words with more are dealt to several.
TOGETHER = 1 << 20
END_WORD = b"\n"
_MARKS = frozenset(b".,;:!?)\"'|")
#: Ending classes: 26 letters or another, each with or without a mark after it; one for words without a letter there.
ENDINGS = 2 * 27 + 1


def ending(word: bytes) -> int:
    """The ending class of a word."""
    bare = word.rstrip(b".,;:!?)\"'|")
    if not bare:
        return ENDINGS - 1
    last = bare[-1]
    if last < 128 and not 97 <= last <= 122:
        return ENDINGS - 1
    return 2 * (last - 97 if last < 128 else 26) + (len(bare) < len(word))


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


END_HASH = word_hash(END_WORD)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


# -- blocks


class Words:
    """Numbers of words as a Python worker meets them, with their hashes and ending classes."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes, self.endings = array("q"), array("B")
        self._learn(END_WORD)

    def _learn(self, word: bytes) -> int:
        self.known[word] = k = len(self.hashes)
        self.hashes.append(word_hash(word))
        self.endings.append(ending(word))
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            known, learn = self.known, self._learn
            found = [(known.get(w) or learn(w)) if c is None else c for w, c in zip(words, found)]
        found.append(0)
        return np.array(found, np.int32)


_WORDS = Words()
_BLOCKS = (
    "block long, docs array<long>, lengths binary, train binary, hashes binary, endings binary, codes binary"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, train) -> blocks."""
    place = TaskContext.get().partitionId() << 16
    docs, train, parts, n = [], [], [], 0

    def flush() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        local, codes = np.unique(ids, return_inverse=True)
        row = {
            "block": pa.array([place], pa.int64()),
            "docs": pa.array([docs], pa.list_(pa.int64())),
            "lengths": pa.array([np.array([len(p) for p in parts], np.int32).tobytes()], pa.binary()),
            "train": pa.array([np.array(train, np.uint8).tobytes()], pa.binary()),
            "hashes": pa.array([np.array(_WORDS.hashes, np.int64)[local].tobytes()], pa.binary()),
            "endings": pa.array([np.array(_WORDS.endings, np.uint8)[local].tobytes()], pa.binary()),
            "codes": pa.array([codes.astype(np.uint16 if len(local) <= 1 << 16 else np.uint32).tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(row)

    for b in batches:
        for i, t, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            parts.append(_WORDS.of(tokens(t.as_py())))
            docs.append(i)
            train.append(bool(own))
            n += len(parts[-1])
            if n >= BLOCK:
                yield flush()
                docs, train, parts, n = [], [], [], 0
                place += 1
                if len(_WORDS.known) > HELD:
                    _WORDS.clear()
    if parts:
        yield flush()


def encode(docs: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    """The staged blocks of all documents; ``train`` says which are learned from."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), train.alias("train"))
    return stage(rows.mapInArrow(_blocks, _BLOCKS), "blocks", "zstd")


class Block:
    """A block's arrays: lengths, train (one per document), hashes, endings (one per word), codes (one per token)."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        wide = len(row["codes"]) // max(1, int(self.lengths.sum()))
        self.codes = np.frombuffer(row["codes"], np.uint16 if wide == 2 else np.uint32).astype(np.int64)
        if "hashes" in row:
            self.hashes = np.frombuffer(row["hashes"], np.int64)
            self.endings = np.frombuffer(row["endings"], np.uint8).astype(np.int64)

    def learned(self) -> np.ndarray:
        """Which tokens are learned from."""
        return np.repeat(self.train, self.lengths)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block({name: b.column(name)[k].as_py() for name in b.schema.names})


# -- counts


def _summed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(h, ending, n) with equal hashes as one row."""
    h, e, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h, e, n = h[order], e[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return pa.RecordBatch.from_pydict({"h": h[first], "ending": e[first].astype(np.int32), "n": np.add.reduceat(n, first)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for b in _each(batches):
        n = np.bincount(b.codes[b.learned()], minlength=len(b.hashes))
        at = np.flatnonzero(n)
        if len(at):
            parts.append((b.hashes[at], b.endings[at], n[at]))
            held += len(at)
        if held > 1_000_000:
            yield _summed(parts)
            parts, held = [], 0
    if parts:
        yield _summed(parts)


def count_words(blocks: DataFrame) -> DataFrame:
    """(h, ending, n) of each word of the learned documents, the end token included."""
    rows = blocks.select("lengths", "train", "hashes", "endings", "codes").mapInArrow(_counted, "h long, ending int, n long")
    return rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


class Listed:
    """The most frequent words by rank, found by hash."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """The ranks of words; -1 for others."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def sieves(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of the words that stand twice or more, and MIN_COUNT times or more; others pass by chance."""
    place = F.col("h").bitwiseAND(F.lit(SIEVE - 1))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    often = counts.filter("n > 1").withColumn("place", place).withColumn("bit", bit)
    rows = often.groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.bit_or("bit").alias("two"), F.bit_or(F.when(F.col("n") >= MIN_COUNT, F.col("bit")).otherwise(F.lit(0))).alias("more")
    )
    found = rows.toArrow()  # at most SIEVE / 64 rows
    out = np.zeros((2, SIEVE // 64), np.uint64)
    for k, name in enumerate(("two", "more")):
        out[k, found["at"].to_numpy()] = found[name].to_numpy().view(np.uint64)
    return out[0], out[1]


def passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) & np.uint64(SIEVE - 1)
    return (sieve[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _units(b: Block, listed: Listed, core: int) -> np.ndarray:
    """Each word's unit: core words 0.., the end token ``core``, others ``core`` + 1 + their ending class."""
    rank = listed.rank(b.hashes)
    unit = np.where((rank >= 0) & (rank < core), rank, core + 1 + b.endings)
    unit[b.hashes == END_HASH] = core
    return unit


def count_bigrams(blocks: DataFrame, hashes: np.ndarray, core: int) -> DataFrame:
    """(pair, n): pairs of units, first * units + second, in the learned documents."""
    shared = blocks.sparkSession.sparkContext.broadcast(hashes)
    units = core + 1 + ENDINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, held, n = Listed(shared.value), [], 0

        def flush() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"pair": pairs, "n": counts.astype(np.int64)})

        for b in _each(batches):
            u = _units(b, listed, core)[b.codes]
            held.append((np.concatenate([[core], u[:-1]]) * units + u)[b.learned()])
            n += len(held[-1])
            if n > 6_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    rows = blocks.select("lengths", "train", "hashes", "endings", "codes").mapInArrow(run, "pair long, n long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two columns of many batches at once."""
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= rows:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _pair_table(rows: DataFrame, n: int) -> np.ndarray:
    """[first class, second class]: counts of the rows (pair, n), of which at most n * n reach the driver."""
    out = np.zeros(n * n)
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(n, n)


def class_bigrams(bigrams: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs from those of units, summed in tasks and then over tasks."""
    n = int(classes.max()) + 1
    shared = bigrams.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        total = np.zeros(n * n)
        for pair, count in _gathered(batches):
            first, second = np.divmod(pair, len(cls))
            total += np.bincount(cls[first] * n + cls[second], count, n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": at, "n": total[at].astype(np.int64)})

    return _pair_table(bigrams.mapInArrow(run, "pair long, n long"), n)


# -- exchange


def exchange(bigrams: DataFrame, classes: np.ndarray, core: int, learned: int, turn: int) -> np.ndarray:
    """One turn: the core words whose number is ``turn`` modulo TURNS move to their best class.

    Tasks sum each word's neighbours by class over their share of the bigrams; those sums are dealt by groups of words.
    There the words are moved one after the other, each to the class with the greatest gain of likelihood given the
    moves of its group before it; words of other groups stay as they are.
    """
    spark = bigrams.sparkSession
    table = class_bigrams(bigrams, classes)
    n = len(table)
    shared = spark.sparkContext.broadcast((classes, table))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, _ = shared.value
        total = np.zeros(core * 2 * n)
        for pair, count in _gathered(batches):
            first, second = np.divmod(pair, len(cls))
            for own, other, side in ((first, second, 0), (second, first, 1)):
                moving = (own < core) & (own % TURNS == turn)
                at = (own[moving] * 2 + side) * n + cls[other[moving]]
                total += np.bincount(at, count[moving], len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            word, cell = np.divmod(part, 2 * n)
            yield pa.RecordBatch.from_pydict({"word": word, "cell": cell, "n": total[part].astype(np.int64)})

    def best(cells: pa.Table) -> pa.Table:
        cls, table_ = shared.value
        words, at = np.unique(cells["word"].to_numpy(), return_inverse=True)
        sums = np.bincount(at * 2 * n + cells["cell"].to_numpy(), cells["n"].to_numpy(), len(words) * 2 * n)
        moved, g = [], table_.copy()
        for word, counts in zip(words.tolist(), sums.reshape(-1, 2 * n)):
            after, before = counts[:n], counts[n:]
            g[cls[word]] -= after
            g[:, cls[word]] -= before
            np.maximum(g, 0, out=g)
            gain = np.zeros(learned)
            for own, count in ((g[:learned], after), (g[:, :learned].T, before)):
                at = np.flatnonzero(count)
                gain += (_phi(own[:, at] + count[at]) - _phi(own[:, at])).sum(axis=1)
                margin = own.sum(axis=1)
                gain -= _phi(margin + count.sum()) - _phi(margin)
            to = int(gain.argmax())
            g[to] += after
            g[:, to] += before
            moved.append(to)
        return pa.table({"word": words, "cls": np.array(moved, np.int64)})

    found = (
        bigrams.mapInArrow(neighbours, "word long, cell long, n long")
        .groupBy("word", "cell")
        .agg(F.sum("n").alias("n"))
        .groupBy(F.floor(F.col("word") / GROUP).alias("words"))
        .applyInArrow(best, "word long, cls long")
        .collect()  # at most one row for each core word
    )
    out = classes.copy()
    for r in found:
        out[r["word"]] = r["cls"]
    return out


def best_classes(table: np.ndarray, learned: int, after: tuple, before: tuple, words: int) -> np.ndarray:
    """For each of so many words the class below ``learned`` that gains most likelihood by taking it in.

    Words are decided one by one, so none may go to a class that is empty or small (an eighth of the mean), which any
    word by itself would fit best and all of them together wouldn't.
    ``after`` and ``before`` are (word, class, count) of the classes that follow and precede words, ordered by word.
    """
    gain = np.zeros((words, learned))
    for (word, cell, count), own in ((after, table[:learned]), (before, table[:, :learned].T)):
        for k in range(0, len(word), 20_000):
            part = slice(k, k + 20_000)
            now = own[:, cell[part]].T
            change = _phi(now + count[part, None]) - _phi(now)
            first = np.flatnonzero(np.concatenate([[True], word[part][1:] != word[part][:-1]]))
            gain[word[part][first]] += np.add.reduceat(change, first, axis=0)
        margin = own.sum(axis=1)
        gain -= _phi(margin + np.bincount(word, count, words)[:, None]) - _phi(margin)
    size = table[:learned].sum(axis=1)
    gain[:, size < size.mean() / SMALL] = -np.inf
    return gain.argmax(axis=1)


def _cells(word: np.ndarray, cell: np.ndarray, n: int) -> tuple:
    """(word, class, count) of the distinct pairs, ordered by word."""
    pairs, count = np.unique(word * n + cell, return_counts=True)
    return pairs // n, pairs % n, count.astype(np.float64)


def insert(
    blocks: DataFrame, hashes: np.ndarray, counts: np.ndarray, sieve: np.ndarray, core: int, classes: np.ndarray,
    table: np.ndarray, learned: int,
) -> DataFrame:
    """(h, cls, ending, n): the class of every word beyond the core that stands MIN_COUNT times or more in the learned
    documents, staged.

    Tasks send, for each word, the classes that precede and follow it, a byte each; words are dealt by hash, and very
    frequent ones to several tasks, whose sums meet once more.
    """
    n = len(table)
    shared = blocks.sparkSession.sparkContext.broadcast((hashes, counts, sieve, classes, table))

    def parts_of(h: np.ndarray, listed: Listed, counts_: np.ndarray) -> np.ndarray:
        """To how many tasks each word's neighbours go."""
        rank = listed.rank(h)
        return np.where(rank >= 0, -(-counts_[rank] // TOGETHER), 1) if len(counts_) else np.ones(len(h), np.int64)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_, counts_, sieve_, cls, _ = shared.value
        listed, own = Listed(hashes_), TaskContext.get().partitionId()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, ends, left, right = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, ends, left, right = h[order], ends[order], left[order], right[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(first, len(h)))
            offsets = np.concatenate([[0], np.cumsum(1 + 2 * sizes)])
            data = np.empty(int(offsets[-1]), np.uint8)
            data[offsets[:-1]] = ends[first]
            at = np.repeat(offsets[:-1] + 1 - first, sizes) + np.arange(len(h))
            data[at], data[at + np.repeat(sizes, sizes)] = left, right
            near = pa.BinaryArray.from_buffers(
                pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
            )
            part = own % np.maximum(parts_of(h[first], listed, counts_), 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(h[first]), pa.array(part.astype(np.int32)), near], names=["h", "part", "near"]
            )

        for b in _each(batches):
            unit = _units(b, listed, core)
            c = cls[unit].astype(np.uint8)[b.codes]
            wanted = (unit > core) & (passes(sieve_, b.hashes) | (listed.rank(b.hashes) >= 0))
            at = np.flatnonzero(b.learned() & wanted[b.codes])
            if len(at):
                end = np.array([cls[core]], np.uint8)
                before, after = np.concatenate([end, c[:-1]]), np.concatenate([c[1:], end])
                word = b.codes[at]
                held.append((b.hashes[word], b.endings[word].astype(np.uint8), before[at], after[at]))
                size += len(at)
            if size > 1_500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_, counts_, _, _, table_ = shared.value
        listed = Listed(hashes_)

        def found(rows: pa.Table) -> pa.RecordBatch:
            h, part, near = rows["h"].to_numpy(), rows["part"].to_numpy(), rows["near"].to_pylist()
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
            word = np.cumsum(new) - 1
            size = np.fromiter(map(len, near), np.int64, len(h))
            data = np.frombuffer(b"".join(near), np.uint8).astype(np.int64)
            start = np.cumsum(size) - size
            at = np.arange(len(data)) - np.repeat(start, size)
            ends = data[start][new]
            total = np.bincount(word, size // 2).astype(np.int64)
            split = parts_of(h[new], listed, counts_) > 1
            keep = split | (total >= MIN_COUNT)
            own, half = np.repeat(word, size), np.repeat(size // 2, size)
            sides = []
            for mine in ((at > half), (at > 0) & (at <= half)):
                mine &= keep[own]
                sides.append(_cells(own[mine], data[mine], n))
            cls = best_classes(table_, learned, *sides, len(total))
            some, many = np.flatnonzero(keep & ~split), np.flatnonzero(split)
            sums = [b"".join(np.bincount(c[w == k], x[w == k], n).tobytes() for w, c, x in sides) for k in many.tolist()]
            order = np.append(some, many)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(h[new][order]), pa.array(cls[order].astype(np.int32)), pa.array(ends[order].astype(np.int32)),
                    pa.array(total[order]), pa.array([*[None] * len(some), *sums], pa.binary()),
                ],
                names=["h", "cls", "ending", "n", "sums"],
            )

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows + (b.nbytes >> 5)
            if size > 200_000:
                rows = pa.Table.from_batches(held).combine_chunks()
                h, part = rows["h"].to_numpy(), rows["part"].to_numpy()
                other = np.flatnonzero((h != h[-1]) | (part != part[-1]))
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield found(rows.slice(0, last).combine_chunks())
                held = rows.slice(last).combine_chunks().to_batches()
                size = sum(x.num_rows for x in held)
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    rows = blocks.select("lengths", "train", "hashes", "endings", "codes")
    rows = rows.mapInArrow(neighbours, "h long, part int, near binary").repartition("h", "part").sortWithinPartitions("h", "part")
    decided = stage(rows.mapInArrow(decide, "h long, cls int, ending int, n long, sums binary"), "decided")

    def join_sums(key: tuple, parts: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.float64) for x in parts["sums"].to_pylist())
        sides = []
        for x in (sums[:n], sums[n:]):
            at = np.flatnonzero(x)
            sides.append((np.zeros(len(at), np.int64), at, x[at]))
        cls = best_classes(shared.value[4], learned, *sides, 1)
        row = {"h": [key[0].as_py()], "cls": [int(cls[0])], "ending": [parts["ending"][0].as_py()], "n": [sum(parts["n"].to_pylist())]}
        return pa.table({c: pa.array(v, pa.int64() if c in "hn" else pa.int32()) for c, v in row.items()})

    kind = "h long, cls int, ending int, n long"
    split = decided.filter("sums IS NOT NULL").groupBy("h").applyInArrow(join_sums, kind)
    inserted = stage(decided.filter("sums IS NULL").drop("sums").unionByName(split), "inserted")
    unstage(decided)
    return inserted


# -- the model


def learn(blocks: DataFrame, rounds: int = ROUNDS) -> dict:
    """The model of the blocks' learned documents, all but its class bigrams: ``words`` (h, ending, n) and ``inserted``
    (h, cls, ending, n) are staged tables, the rest is of bounded size."""
    counts = stage(count_words(blocks), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.filter(F.col("h") != END_HASH)
    top = words.orderBy(F.desc("n"), "h").limit(LISTED).toArrow()
    ends = counts.filter(F.col("h") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hashes, n, ending_of = top["h"].to_numpy(), top["n"].to_numpy(), top["ending"].to_numpy().astype(np.int64)
    core = min(CORE, len(hashes))
    learned = max(1, min(core, MOST, max(FEWEST, round(float(total) ** 0.25))))
    classes = np.empty(core + 1 + ENDINGS, np.int64)
    classes[:core] = np.arange(core) % learned
    classes[core] = learned
    classes[core + 1 :] = learned + 1 + np.arange(ENDINGS)
    inserted = counts.select("h", F.lit(0).alias("cls"), "ending", "n").limit(0)
    two, more = sieves(words)
    if core:
        bigrams = stage(count_bigrams(blocks, hashes, core), "bigrams", "zstd")
        for k in range(rounds):
            classes = exchange(bigrams, classes, core, learned, k % TURNS)
        inserted = insert(blocks, hashes, n, more, core, classes, class_bigrams(bigrams, classes), learned)
        unstage(bigrams)
    first = learned + 1
    cls = first + ending_of
    cls[:core] = classes[:core]
    found = inserted.orderBy(F.desc("n"), "h").limit(LISTED).toArrow()
    rank = Listed(hashes).rank(found["h"].to_numpy())
    cls[rank[rank >= 0]] = found["cls"].to_numpy()[rank >= 0]
    in_class, distinct_in = np.zeros(first + ENDINGS), np.zeros(first + ENDINGS)
    for r in words.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        in_class[first + r["ending"]], distinct_in[first + r["ending"]] = r["n"], r["v"]
    for of, to, k, v in (
        [(first + e, c, k, 1) for e, c, k in zip(ending_of[:core].tolist(), classes[:core].tolist(), n[:core].tolist())]
        + [
            (first + r["ending"], r["cls"], r["n"], r["v"])
            for r in inserted.groupBy("cls", "ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        ]
    ):
        in_class[of] -= k
        distinct_in[of] -= v
        in_class[to] += k
        distinct_in[to] += v
    return {
        "words": words, "inserted": inserted, "total": int(total), "distinct": int(distinct), "ends": int(ends),
        "learned": learned, "core": core, "hashes": hashes, "n": n, "cls": cls, "two": two, "in_class": in_class,
        "distinct_in": distinct_in,
    }


def vocabulary(model: dict) -> DataFrame:
    """(h, n, cls) of every word but the end token."""
    spark = model["words"].sparkSession
    core = list(zip(model["hashes"][: model["core"]].tolist(), model["cls"][: model["core"]].tolist()))
    found = model["inserted"].select("h", "cls").unionByName(spark.createDataFrame(core, "h long, cls int"))
    own = F.coalesce("cls", F.lit(model["learned"] + 1) + F.col("ending")).cast("int")
    return model["words"].join(found, "h", "left").select("h", "n", own.alias("cls"))


_RESOLVED = "block long, docs array<long>, lengths binary, train binary, n binary, cls binary, codes binary"
#: What stands for a word's rank where it has none: to be looked up, the end token, once in the learned documents.
ASKED, ENDS, ONCE = -1, -2, -3


def _ranks(b: Block, listed: Listed, two: np.ndarray) -> np.ndarray:
    """Each word's rank, or why it has none. A word of a learned document that the sieve doesn't pass stands once."""
    rank = listed.rank(b.hashes)
    here = np.zeros(len(rank), bool)
    here[b.codes[b.learned()]] = True
    rank[(rank < 0) & here & ~passes(two, b.hashes)] = ONCE
    rank[b.hashes == END_HASH] = ENDS
    return rank


def resolve(blocks: DataFrame, model: dict, learned: bool = True) -> DataFrame:
    """The blocks with every word's count and class (of its ending, for words that the model hasn't), staged; the
    blocks themselves are deleted.

    ``learned`` says that the model was learned from these blocks, so that words that stand once needn't be looked up.
    """
    light = {c: model[c] for c in ("hashes", "n", "cls", "learned", "ends")}
    light["two"] = model["two"] if learned else np.full(SIEVE // 64, ~np.uint64(0))
    shared = blocks.sparkSession.sparkContext.broadcast(light)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        listed = Listed(m["hashes"])
        for b in _each(batches):
            at = np.flatnonzero(_ranks(b, listed, m["two"]) == ASKED)
            yield pa.RecordBatch.from_pydict({"place": (b.row["block"] << 26) + at, "h": b.hashes[at]})

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        listed = Listed(m["hashes"])
        for b in _each(batches):
            b.row["ranks"] = _ranks(b, listed, m["two"]).astype(np.int32).tobytes()
            yield _row(b.row, ["block", "docs", "lengths", "train", "ranks", "endings", "codes"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _each(batches):
            rank = np.frombuffer(b.row["ranks"], np.int32)
            endings = np.frombuffer(b.row["endings"], np.uint8).astype(np.int64)
            n, cls = (rank == ONCE).astype(np.int64), m["learned"] + 1 + endings
            known = rank >= 0
            n[known], cls[known] = m["n"][rank[known]], m["cls"][rank[known]]
            n[rank == ENDS], cls[rank == ENDS] = m["ends"], m["learned"]
            if b.row["answers"]:
                v = np.array(b.row["answers"], np.int64)
                at, c = v >> 37, v >> 29 & 0xFF
                n[at] = v & (1 << 29) - 1
                cls[at] = np.where(c < 255, c, cls[at])
            b.row["n"], b.row["cls"] = n.tobytes(), cls.astype(np.uint8).tobytes()
            yield _row(b.row, ["block", "docs", "lengths", "train", "n", "cls", "codes"])

    far = blocks.select("block", "lengths", "train", "hashes", "endings", "codes").mapInArrow(asked, "place long, h long")
    found = far.join(model["words"].select("h", "n"), "h").join(model["inserted"].select("h", "cls"), "h", "left")
    # place in the block, class (255: its ending's) and count (words beyond the listed ones are rare) in one number
    answer = F.expr("shiftleft(place & 67108863L, 37) | shiftleft(cast(coalesce(cls, 255) AS bigint), 29) | least(n, 536870911L)")
    found = found.groupBy(F.shiftright("place", 26).alias("block")).agg(F.collect_list(answer).alias("answers"))
    slim = blocks.mapInArrow(ranked, "block long, docs array<long>, lengths binary, train binary, ranks binary, endings binary, codes binary")
    resolved = stage(slim.join(found, "block", "left").mapInArrow(filled, _RESOLVED), "resolved", "zstd")
    unstage(blocks)
    return resolved


def _row(row: dict, names: list[str]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "docs": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.binary())) for c in names], names=names)


def transitions(resolved: DataFrame, model: dict) -> np.ndarray:
    """Counts of class pairs in the learned documents."""
    n, end = model["learned"] + 1 + ENDINGS, model["learned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for b in _each(batches):
            c = np.frombuffer(b.row["cls"], np.uint8).astype(np.int64)[b.codes]
            pair = np.concatenate([[end], c[:-1]]) * n + c
            total += np.bincount(pair[b.learned()], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": at, "n": total[at]})

    return _pair_table(resolved.select("lengths", "train", "cls", "codes").mapInArrow(run, "pair long, n long"), n)


def tables(m: dict) -> dict:
    """Transition probabilities, the emissions' divisors and the base model's, from the model's counts."""
    g = m["table"]
    mass = g.sum(axis=0)
    own = (mass + 1) / (mass.sum() + len(g))
    transition = (g + PULL * own) / (g.sum(axis=1, keepdims=True) + PULL)
    emits = np.maximum(m["in_class"], 1)
    first = m["learned"] + 1
    emits[first:] = m["in_class"][first:] + m["distinct_in"][first:] + 1
    return {
        "transition": transition, "emits": emits, "z": m["total"] + m["distinct"] + 1.0, "learned": m["learned"],
        "share": SHARE if m["total"] else 0.0,
    }


def token_scores(t: dict, n: np.ndarray, cls: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the model's and of the base model's probability of tokens with counts, classes and classes before them."""
    rare = cls > t["learned"]
    emission = np.where(cls == t["learned"], 1.0, (n + rare) / t["emits"][cls])
    plain = (n + 1) / t["z"]
    value = t["share"] * t["transition"][before, cls] * emission + (1 - t["share"]) * plain
    return np.log10(np.maximum(value, 1e-300)), np.log10(plain)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(resolved: DataFrame, model: dict) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities)."""
    shared = resolved.sparkSession.sparkContext.broadcast(tables(model))
    total = model["total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in _each(batches):
            n = np.frombuffer(b.row["n"], np.int64)[b.codes]
            c = np.frombuffer(b.row["cls"], np.uint8).astype(np.int64)[b.codes]
            value, base = token_scores(t, n, c, np.concatenate([[t["learned"]], c[:-1]]))
            first = np.cumsum(b.lengths) - b.lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.row["docs"], pa.int64()), pa.array(~b.train), pa.array(b.lengths),
                    pa.array(np.add.reduceat((n > 0).astype(np.int64), first)), pa.array(np.full(len(first), total)),
                    pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(value, first)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return resolved.mapInArrow(run, _SCORES)


def learn_and_score(
    docs: DataFrame, held_out: Column, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The scores of all documents by the model of those that aren't held out. Texts are read once for both."""
    blocks = encode(docs, doc_id, text, ~F.coalesce(held_out, F.lit(False)))
    model = learn(blocks, rounds)
    resolved = resolve(blocks, model)
    return score_blocks(resolved, model | {"table": transitions(resolved, model)})


def train(docs: DataFrame, rounds: int = ROUNDS, text: str = "text") -> dict:
    """The model learned from the texts of ``docs``."""
    blocks = encode(docs.select(F.lit(0).alias("id"), F.col(text).alias("text")), "id", "text", F.lit(True))
    model = learn(blocks, rounds)
    return model | {"table": transitions(resolve(blocks, model), model)}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities)."""
    blocks = encode(docs, doc_id, text, F.lit(False))
    return score_blocks(resolve(blocks, model, learned=False), model).drop("held_out")
