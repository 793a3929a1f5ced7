"""Lexicon phrases that stand anywhere in a text, upper and lower case alike.

Few phrases are searched one by one inside the query's own code; more by an automaton that every Python worker builds
once and that reads each text once, whatever the number of phrases; a lexicon too long for that is a table, searched shard by
shard by an index of its phrases' rarest grams, which is broadcast. All three give the same hits: a text's hits stand in the lexicon's order,
repeated phrases are repeated hits, empty phrases hit nothing, and a null text has no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.staging import bounded_batches, stage, unstage

#: Phrases up to which they are searched one by one, and up to which a table of them is an automaton in each worker.
INLINE, LISTED = 24, 20_000
#: Phrases and bytes of them that one index holds; places of texts, and candidates, that are looked at at once.
SHARD, SHARD_BYTES, PLACES = 1 << 21, 1 << 26, 1 << 18
#: Bytes of a gram, the longest that fits a phrase; buckets in which grams are counted; bits of a place in a table of grams.
GRAMS, BUCKETS, MOST_BITS = (32, 16, 8), 1 << 16, 24
#: Zeros after strings, so that the longest gram begins at each of their bytes.
PAD = 40
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Automaton:
    """Aho-Corasick over lower-cased phrases."""

    def __init__(self, phrases: list[str]) -> None:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for k, p in enumerate(phrases):
            if p:
                places.setdefault(p.lower(), []).append(k)
        self.found = ahocorasick.Automaton()
        for p, ks in places.items():
            self.found.add_word(p, ks)
        self.any = bool(places)
        if self.any:
            self.found.make_automaton()

    def hits(self, text: str | None) -> list[int]:
        """Places of the phrases that the text has, in order."""
        if not text or not self.any:
            return []
        return sorted({k for _, ks in self.found.iter(text.lower()) for k in ks})


_BUILT: dict[str, Automaton] = {}


def automaton(phrases: list[str], key: str) -> Automaton:
    """Built once in each Python worker; the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(phrases)
    return _BUILT[key]


def _search(phrases: list[str], key: str, texts: pd.Series) -> pd.Series:
    found = automaton(phrases, key)
    return texts.map(lambda t: [phrases[k] for k in found.hits(t)])


def _search_batches(phrases: list[str], key: str, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield _search(phrases, key, texts)


def lexicon_hits(text: Column, phrases: list[str]) -> Column:
    """The lower-cased phrases that stand anywhere in the text: array<string>."""
    low = [p.lower() for p in phrases]
    if len(low) > INLINE:
        key = hashlib.md5("\n".join(low).encode("utf-8", "replace")).hexdigest()
        search = partial(_search_batches, low, key)

        @F.pandas_udf("array<string>")
        def search_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return search(batches)

        found = search_udf.asNondeterministic()(text)  # else filters on the hits search once more
        return F.coalesce(found, F.array().cast("array<string>"))
    if not any(low):
        return F.array().cast("array<string>")
    own = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(own, F.lit(p)), F.lit(p)) for p in low if p]))


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all strings in a row, with PAD zeros after it, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(PAD, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    own = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return np.concatenate([own, np.zeros(PAD, np.uint8)]), ends - ends[0]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; a view."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    value = a * _STEP
    value += b * _MIX
    value ^= value >> np.uint64(29)
    return value


def _wider(eights: np.ndarray) -> dict[int, np.ndarray]:
    """By size of GRAMS a number for the bytes from each place on: eight themselves, hashes of more."""
    sixteens = _pair(eights[:-8], eights[8:])
    return {8: eights, 16: sixteens, 32: _pair(sixteens[:-16], sixteens[16:])}


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * _STEP) >> np.uint64(64 - bits)).view(np.int64)


def _gram_sizes(lengths: np.ndarray) -> np.ndarray:
    """The size of phrases' grams: the longest of GRAMS that they have room for, or all of a shorter phrase."""
    return np.select([lengths >= g for g in GRAMS], GRAMS, lengths)


def _phrase_grams(phrases: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The gram from each place of phrases that aren't empty on, if it fits the phrase, how far in the phrase it is, and the
    phrases' beginnings and sizes of grams."""
    data, ends = _strings(phrases)
    lengths, n = np.diff(ends), ends[-1]
    sizes, wider = _gram_sizes(lengths), _wider(_eights(data))
    size, within = np.repeat(sizes, lengths), np.arange(n) - np.repeat(ends[:-1], lengths)
    value = np.select([size == 32, size == 16], [wider[32][:n], wider[16][:n]], wider[8][:n] & _MASKS[np.minimum(size, 8)])
    return value, within + size <= np.repeat(lengths, lengths), within, ends[:-1], sizes


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): how many grams of a partition's phrases fall into each bucket of their hashes."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        if batch.num_rows:
            value, fits, *_ = _phrase_grams(batch.column(0))
            n += np.bincount(_slots(value[fits], 16), minlength=BUCKETS)
    own = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["bucket", "n"])


def _gram_counts(low: DataFrame) -> np.ndarray:
    """By bucket, how many grams of the lower-cased phrases fall into it; the driver gets BUCKETS rows at most."""
    counts = low.select("phrase").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return often


def _rarest_grams(often: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, phrase, gram, size, at): each phrase with its gram of the emptiest bucket, and where in the phrase that is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        value, fits, within, begins, sizes = _phrase_grams(batch.column(1))
        cost = np.where(fits, np.minimum(often[_slots(value, 16)], (1 << 30) - 1), 1 << 30)
        at = np.minimum.reduceat(cost << 32 | within, begins) & 0xFFFFFFFF
        made = [pa.array(value[begins + at].view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(at.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "gram", "size", "at"])


def _packed(often: np.ndarray, columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(packed): columns of a partition's ``_rarest_grams`` as one compressed Arrow stream."""
    rows, sink = list(_rarest_grams(often, batches)), pa.BufferOutputStream()
    if rows:
        table = pa.Table.from_batches(rows).select(columns).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], names=["packed"])


def _lowered(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("pos", F.lower("phrase").alias("phrase")).filter("phrase <> ''")


def _with_grams(low: DataFrame, often: np.ndarray) -> DataFrame:
    kind = low.schema["pos"].dataType.simpleString()
    return low.mapInArrow(partial(_rarest_grams, often), f"pos {kind}, phrase string, gram long, size int, at int")


def index_of(lexicon: DataFrame) -> DataFrame:
    """(pos, phrase, gram, size, at): each lower-cased phrase of (pos, phrase) with a gram that few phrases have.

    Which are few is told by counts in BUCKETS buckets, so that no phrase is copied by the number of its grams.
    """
    low = _lowered(lexicon)
    return _with_grams(low, _gram_counts(low))


class Index:
    """Phrases (phrase, at; pos, where hits are asked for) by their grams. Where a text has one, its phrases are compared with the text byte by byte."""

    def __init__(self, tables: Iterator[pa.Table]) -> None:
        parts = [{c: t[c].chunks for c in t.schema.names} for t in tables]
        self.pos, phrases, at = (pa.concat_arrays([x for p in parts for x in p.pop(c)]) if c in parts[0] else None for c in ("pos", "phrase", "at"))
        data, self.ends = _strings(phrases)
        n, phrases = len(phrases), None  # data has them
        self.phrases = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(self.ends), pa.py_buffer(data)])
        self.eights, self.at, self.by_size = _eights(data), at.to_numpy(), {}
        sizes, places = _gram_sizes(np.diff(self.ends)), self.ends[:-1] + self.at
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            wide = [self.eights[places[own] + k] for k in range(0, max(size, 8), 8)]
            while len(wide) > 1:
                wide = [_pair(a, b) for a, b in zip(wide[::2], wide[1::2], strict=True)]
            value = wide[0] & _MASKS[min(size, 8)]
            order = np.argsort(value)
            keys, starts = np.unique(value[order], return_index=True)
            bits = min(MOST_BITS, max(10, (16 * len(keys)).bit_length()))
            table = np.zeros(1 << bits, bool)
            table[_slots(keys, bits)] = True
            self.by_size[size] = keys, np.append(starts, len(own)).astype(np.int32), own[order].astype(np.int32), table, bits
        self._ranks = None

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) of every phrase in every text, each pair once, in order."""
        data, ends = _strings(texts)
        eights, n, found = _eights(data), int(ends[-1]), []
        for begin in range(0, n, PLACES):
            many = min(PLACES, n - begin)
            wider = _wider(np.array(eights[begin : begin + many + 24]))
            for size, (keys, starts, entries, table, bits) in self.by_size.items():
                grams = wider[max(size, 8)][:many]
                if size < 8:
                    grams = grams & _MASKS[size]
                at = np.flatnonzero(table[_slots(grams, bits)])
                own = grams[at]
                k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                same = keys[k] == own
                if not same.any():
                    continue
                at, lo, hi = at[same] + begin, starts[k[same]], starts[k[same] + 1]
                blocks = np.cumsum(hi - lo, dtype=np.int64) // PLACES  # some PLACES candidates at once
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(blocks)) + 1):
                    found.append(self._verified(eights, ends, at[part], lo[part], hi[part], entries))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF

    def _verified(self, eights: np.ndarray, ends: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """text * 2 ** 32 + phrase for the phrases of entries[lo:hi] that really stand about the places ``at``."""
        each = (hi - lo).astype(np.int64)
        phrase = entries[np.arange(each.sum()) + np.repeat(lo - np.cumsum(each) + each, each)].astype(np.int64)
        at = np.repeat(at, each)
        text = np.searchsorted(ends, at, "right") - 1
        own = self.ends[phrase]
        start, length = at - self.at[phrase], self.ends[phrase + 1] - own
        held = np.flatnonzero((start >= ends[text]) & (start + length <= ends[text + 1]))
        pair, start, own, left = (text[held] << 32) | phrase[held], start[held], own[held], length[held]
        done = []
        while len(pair):
            same = ((eights[start] ^ self.eights[own]) & _MASKS[np.minimum(left, 8)]) == 0
            done.append(pair[same & (left <= 8)])
            pair, start, own, left = (x[same & (left > 8)] for x in (pair, start + 8, own + 8, left - 8))
        return np.unique(np.concatenate(done)) if done else pair

    def hits(self, texts: pa.Array) -> pa.Array:
        """array<struct<pos, phrase>> of each text."""
        text, phrase = self.find(texts)
        listed = pa.StructArray.from_arrays([self.pos.take(pa.array(phrase)), self._named(pa.array(phrase))], ["pos", "phrase"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)), listed)

    def counts(self, texts: pa.Array) -> pa.Array:
        """struct<n, first> of each text: how many phrases it has, and the first of them by their code points."""
        if self._ranks is None:
            order = pc.sort_indices(self.phrases).to_numpy().astype(np.int32)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            self._ranks = order, rank
        (order, rank), (text, phrase) = self._ranks, self.find(texts)
        n, first = np.bincount(text, minlength=len(texts)), np.full(len(texts), -1)
        if len(text):
            own, begins = np.unique(text, return_index=True)
            first[own] = order[np.minimum.reduceat(rank[phrase], begins)]
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), self._named(pa.array(first, mask=n == 0))], ["n", "first"])

    def _named(self, phrase: pa.Array) -> pa.Array:
        return self.phrases.take(phrase).cast(pa.string())


_INDEXED: dict[str, Index] = {}


def _index(key: str, shared) -> Index:
    """The index that a broadcast table makes, built once in each Python worker; the last one is kept."""
    if key not in _INDEXED:
        _INDEXED.clear()
        _INDEXED[key] = Index(pa.ipc.open_stream(x).read_all() for x in shared.value)
        pa.default_memory_pool().release_unused()
    return _INDEXED[key]


def _searches(lexicon: DataFrame, made: str, kind: str) -> list[Callable[[Column], Column]]:
    """Functions of a lower-cased text, one for each shard of (pos, phrase): what ``Index.made`` gives for it, a ``kind``.

    A shard has some SHARD phrases or SHARD_BYTES bytes at most; the driver gets it compressed and broadcasts it. No text is
    shuffled and no hit is written: each shard costs one more reading of the texts instead.
    """
    low, context = _lowered(lexicon), lexicon.sparkSession.sparkContext
    n, size = low.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    if not n:
        return [lambda text: F.array().cast(kind) if made == "hits" else F.lit(None).cast(kind)]
    columns = ["pos", "phrase", "at"] if made == "hits" else ["phrase", "at"]
    shards, often = max(1, -(-n // SHARD), -(-size // SHARD_BYTES)), _gram_counts(low)

    def search(k: int) -> Callable[[Column], Column] | None:
        part = low.filter(F.pmod(F.xxhash64("phrase", "pos"), F.lit(shards)) == k)
        packed = part.mapInArrow(partial(_packed, often, columns), "packed binary").collect()
        if not packed:
            return None
        key, shared = uuid.uuid4().hex, context.broadcast([bytes(r["packed"]) for r in packed])

        @F.arrow_udf(kind)
        def search_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            found = getattr(_index(key, shared), made)  # by one index to the end of the task, whatever others are built
            for texts in batches:
                yield found(texts)

        return search_udf.asNondeterministic()  # else filters on what it gives run it once more

    return [found for k in range(shards) if (found := search(k)) is not None]


def _table_search(rows: list, kind: str):
    """A function of texts: the phrases of (pos, phrase) rows, by an automaton that every Python worker builds once."""
    listed = sorted(((r["pos"], (r["phrase"] or "").lower()) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1]))
    phrases = [p for _, p in listed]
    key = hashlib.md5(repr(listed).encode("utf-8", "replace")).hexdigest()

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = automaton(phrases, key)
            yield texts.map(lambda t: [{"pos": listed[k][0], "phrase": listed[k][1]} for k in found.hits(t)])

    @F.pandas_udf(f"array<struct<pos: {kind}, phrase: string>>")
    def search_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return search(batches)

    return search_udf


def _hit_searches(docs: DataFrame, lexicon: DataFrame, most: int) -> list[Callable[[Column], Column]]:
    """Functions of a text that together give its hits: one automaton, or an index for each shard."""
    bounded_batches(docs.sparkSession)
    lexicon = stage(lexicon.select("pos", "phrase"), "lexicon")  # what makes it is run once
    few, kind = lexicon.limit(most + 1).collect(), lexicon.schema["pos"].dataType.simpleString()
    if len(few) <= most:
        found = [_table_search(few, kind)]
    else:
        indexed = _searches(lexicon, "hits", f"array<struct<pos: {kind}, phrase: string>>")
        found = [lambda text, search=search: search(F.lower(text)) for search in indexed]
    unstage(lexicon)
    return found


def with_hits(docs: DataFrame, lexicon: DataFrame, text: str = "text", name: str = "found", most: int = LISTED) -> DataFrame:
    """``docs`` with ``name``: array<struct<pos, phrase>> of the phrases (pos, phrase) that stand in the text, in their order.

    For lexicons of any length: up to ``most`` phrases are searched by an automaton, beyond that by an index that holds each
    phrase under its rarest gram and compares it with the text wherever that gram is. No text is shuffled as long as one shard
    holds the lexicon (SHARD phrases); of more shards the hits are joined to the texts. Phrases that repeat are repeated
    hits, empty ones hit nothing, a null text has none.
    """
    searches = _hit_searches(docs, lexicon, most)
    if len(searches) == 1:
        return docs.withColumn(name, F.array_sort(searches[0](F.col(text))))
    rows = docs.withColumn("_row", F.sha2(F.col(text), 256))
    each = [rows.select("_row", F.lit(k).alias("_k"), search(F.col(text)).alias("_hits")) for k, search in enumerate(searches)]
    none = F.array().cast(each[0].schema["_hits"].dataType)
    own = [F.coalesce(F.any_value(F.when(F.col("_k") == k, F.col("_hits")), True), none) for k in range(len(each))]
    met = reduce(DataFrame.unionByName, each).filter(F.size("_hits") > 0).groupBy("_row").agg(F.array_sort(F.concat(*own)).alias("_met"))
    return rows.join(met, "_row", "left").withColumn(name, F.coalesce("_met", none)).drop("_row", "_met")


def hits_table(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", most: int = LISTED) -> DataFrame:
    """(key, pos, phrase) of every phrase of the table (pos, phrase) in every text: ``with_hits`` as rows, without a shuffle."""
    each = [docs.select(key, search(F.col(text)).alias("_found")) for search in _hit_searches(docs, lexicon, most)]
    return reduce(DataFrame.unionByName, [x.select(key, F.inline("_found")) for x in each])


def hit_counts(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, first) of the keys whose texts have a phrase of (pos, phrase): how many hits, and the first phrase by its
    code points. What is shuffled is one row for each text and shard that has hits, and never a hit."""
    bounded_batches(docs.sparkSession)
    lexicon = stage(lexicon.select("pos", "phrase"), "lexicon")
    searches = _searches(lexicon, "counts", "struct<n: long, first: string>")
    unstage(lexicon)
    each = reduce(DataFrame.unionByName, [docs.select(key, search(F.lower(text)).alias("_told")) for search in searches])
    return each.select(key, "_told.*").filter("n > 0").groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
