"""Order-preserving packing of tokenized documents into sequences of a fixed length.

Documents, each closed by an end token, stand in the order of doc_id. A dynamic programme chooses where sequences are
cut: at ends of documents (free), at ends of sentences (SENTENCE_COST) or, in stretches without one, inside a sentence
(INNER_COST), minimising padding plus these costs. A sequence is padded to the full length unless its length is a power
of two (1024 or 2048; at the end of a partition 64 to 512 as well). The cost of a padded sequence is linear in its
length, so its best beginning is the front of a monotone queue; beginnings a power of two away are looked up. Documents are dealt by ranges of doc_id; each partition is packed on its
own, in blocks of BLOCK tokens whose open end goes on into the next block.

A null text is empty and still has its end token; documents of equal id stand in the order of their texts and are told apart
by ``copy``, which counts them from 0; null ids come first; texts of any length are cut freely; an empty table gives no piece.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import alone
from brindle.staging import bounded_batches

LENGTH, END = 4096, 2
SENTENCE_COST, INNER_COST, SHORT_COST = 8, 40, 24
#: Tokens without a sentence's end after which inner cuts are offered, and how far apart.
GAP, INNER_STEP = 64, 16
BLOCK = 1 << 18
#: Words whose tokens a Python worker remembers.
REMEMBERED = 1_200_000
#: A run of Latin letters (UTF-8), and marks after it that no contraction of the tokenizer's rule begins.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Lengths of unpadded sequences: anywhere, and near the end of the tokens, where places STEP tokens apart are offered.
POWERS, TAIL_POWERS, STEP = (1024, 2048), (64, 128, 256, 512), 64
_END = END.to_bytes(4, "little")
#: Characters of texts that are encoded together.
TOGETHER = 1 << 20


class WordTokens:
    """Token ids of words. The tokenizer drops white space and never joins words, so words can be remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        # the same model without the rules that runs of one kind don't need, nor its own memory of words
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.model._resize_cache(0)
        split = pre_tokenizers.Split(" ", "removed")
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = max(vocabulary.values()) + 1
        self.closes, self.sentence = np.zeros(size, bool), np.zeros(size, bool)
        for token, k in vocabulary.items():
            self.closes[k] = token.endswith("</w>")
            self.sentence[k] = token.endswith((".</w>", "!</w>", "?</w>"))

    def _encode(self, texts: list[str]) -> list[bytes]:
        batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in batch]

    def _runs(self, runs: list[bytes]) -> None:
        """Remember the ids of runs of Latin letters or of marks, each of which is one piece for the tokenizer's model.
        All are encoded as one text and told apart by the tokens that close them."""
        text = b" ".join(runs).decode().lower()
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
        if len(ends) == len(runs):
            blob, cuts = ids.tobytes(), ends.tolist()
            self.known.update((r, blob[a:b]) for r, a, b in zip(runs, [0, *cuts], cuts))
        else:
            self.known.update(zip(runs, self._encode([r.decode() for r in runs])))

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words: Latin letters and marks after them by runs, any other word by itself."""
        known, plain, other = self.known, [], []
        for w in words:
            m = _PLAIN.fullmatch(w)
            if m:
                plain.append((w, m[1], m[2]))
            else:
                other.append(w)
        if new := [r for r in {r for _, a, b in plain for r in (a, b)} if r and r not in known]:
            self._runs(new)
        for w, a, b in plain:
            if b:
                known[w] = known[a] + known[b]
        known.update(zip(other, self._encode([w.decode("utf-8", "replace") for w in other])))

    def documents(self, texts: list[str | None]) -> list[tuple[bytes, np.ndarray]]:
        """For each text the ids with the end token, as little-endian 32-bit integers, and the places after sentences'
        ends. New words of all the texts are learned together."""
        words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
        parts = [list(map(self.known.get, w)) for w in words]
        new = {x for w, p in zip(words, parts) if None in p for x, y in zip(w, p) if y is None}
        if new:
            self._learn(list(new))
            for w, p in zip(words, parts):
                if None in p:
                    p[:] = [self.known[x] if y is None else y for x, y in zip(w, p)]
            for w in new:
                if len(w) > 64:  # long words aren't kept
                    del self.known[w]
            if len(self.known) > REMEMBERED:
                self.known.clear()
        out = []
        for p in parts:
            p.append(_END)
            blob = b"".join(p)
            out.append((blob, np.flatnonzero(self.sentence[np.frombuffer(blob, "<u4")]) + 1))
        return out


def offered_cuts(sentences: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which documents that end at the places ``ends`` may be cut, rising, and their costs. ``sentences`` are
    the places after sentences' ends; what lies before 0 is packed already."""
    inside = np.setdiff1d(sentences[sentences > 0], np.concatenate([ends, ends - 1]), assume_unique=True)
    places = np.concatenate([ends, inside])
    costs = np.where(np.arange(len(places)) < len(ends), 0, SENTENCE_COST)
    order = np.argsort(places, kind="stable")
    places, costs = places[order], costs[order]
    before = np.concatenate([[0], places[:-1]])
    wide = np.flatnonzero(places - before > GAP)
    if len(wide):
        steps = (places[wide] - before[wide] - 1) // INNER_STEP
        nth = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        inner = np.repeat(before[wide], steps) + nth * INNER_STEP
        places, costs = np.append(places, inner), np.append(costs, np.full(len(inner), INNER_COST, np.int64))
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    return places, costs


def best_cuts(places: list[int], costs: list[int], final: bool, length: int = LENGTH) -> list[int]:
    """The places at which sequences end, the first sequence starting at 0; the last place is used if ``final``.

    cost(j) = costs[j] + the least of: over i with places[j] - places[i] <= length, cost(i) + length - (places[j] -
    places[i]), and over i a power of two before j, cost(i) + SHORT_COST.
    """
    at = [0, *places]
    hops = _hops(np.array(at), length)
    best, ahead, back = [0], [0], [0]  # ahead: best + place
    queue, front = [0], 0  # indices with rising ahead
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[front]] < p - length:
            front += 1
        i = queue[front]
        value = ahead[i] + length - p
        if j in hops:
            for k in hops[j]:
                if best[k] + SHORT_COST < value:
                    value, i = best[k] + SHORT_COST, k
        value += costs[j - 1]
        best.append(value)
        back.append(i)
        value += p
        ahead.append(value)
        while len(queue) > front and ahead[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    j = len(at) - 1
    if not final:
        j = min((k for k in range(1, len(at)) if at[k] > at[-1] - length), key=lambda k: (best[k], -at[k]))
    cuts = []
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    cuts.reverse()
    return cuts


def _hops(at: np.ndarray, length: int) -> dict[int, list[int]]:
    """For each index the indices whose place is one of the POWERS before its own; within the last ``length`` tokens
    also one of the TAIL_POWERS."""
    found: dict[int, list[int]] = {}
    near = int(np.searchsorted(at, at[-1] - length))
    for sizes, first in ((POWERS, 0), (TAIL_POWERS, near)):
        for size in sizes:
            own = at[first:] - size
            i = np.searchsorted(at, own)
            for j in np.flatnonzero(at[i] == own).tolist():
                found.setdefault(first + j, []).append(int(i[j]))
    return found


def with_tail(places: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Also offers the places STEP, 2 * STEP, ... before the last one, so that the tokens can end in sequences of powers
    of two instead of one that is mostly padding."""
    tail = np.setdiff1d(np.arange(places[-1] - STEP, max(0, places[-1] - length), -STEP), places)
    order = np.argsort(np.append(places, tail), kind="stable")
    return np.append(places, tail)[order], np.append(costs, np.full(len(tail), INNER_COST, np.int64))[order]


class Packer:
    """Holds documents until a block is full and turns them into pieces."""

    def __init__(self, first_sequence: int) -> None:
        self.docs: list[tuple[int | None, bytes, np.ndarray, int]] = []
        self.last: tuple[int | None, int] = (None, -1)  # the last document's id, and how many of that id came before it
        self.used = 0  # tokens of the first document that are packed already
        self.held = 0
        self.sequence = first_sequence

    def add(self, doc_id: int | None, ids: bytes, sentences: np.ndarray) -> list[tuple]:
        copy = self.last[1] + 1 if self.last[1] >= 0 and self.last[0] == doc_id else 0
        self.last = (doc_id, copy)
        self.docs.append((doc_id, ids, sentences, copy))
        self.held += len(ids) // 4
        return self.pack(False) if self.held >= BLOCK else []

    def pack(self, final: bool) -> list[tuple]:
        """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, copy."""
        if not self.docs:
            return []
        sizes = np.array([len(ids) // 4 for _, ids, _, _ in self.docs])
        ends = np.cumsum(sizes) - self.used
        starts = (ends - sizes).tolist()
        sentences = np.concatenate([x for _, _, x, _ in self.docs]) + np.repeat(
            starts, [len(x) for _, _, x, _ in self.docs]
        )
        places, costs = offered_cuts(sentences.astype(np.int64), ends)
        if final:
            places, costs = with_tail(places, costs)
        cuts = best_cuts(places.tolist(), costs.tolist(), final)
        pieces, d, at = [], 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, ids, _, copy = self.docs[d]
                total = len(ids) // 4
                take = min(cut, starts[d] + total) - at
                own = at - starts[d]
                crc = zlib.crc32(memoryview(ids)[4 * own : 4 * (own + take)])
                pieces.append((doc_id, own, take, crc, total, self.sequence, offset, copy))
                offset += take
                at += take
                if at == starts[d] + total:
                    d += 1
            self.sequence += 1
        self.held -= at
        self.used = at - starts[d] if d < len(self.docs) else 0
        self.docs = self.docs[d:]
        return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, copy long"
_NAMES = [x.split()[0] for x in PIECES.split(",")]
_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """Made once in each Python worker, and kept from task to task."""
    made = alone(_TOKENS)
    if path not in made:
        made[path] = WordTokens(path)
    return made[path]


def _together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of about TOGETHER characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, as in ``PIECES``; ``sequence_id`` holds the partition above bit 40."""
    bounded_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40)
        for b in batches:
            ids = iter(b.column(0).to_pylist())
            for texts in _together(t.as_py() for t in b.column(1)):
                for (blob, sentences), i in zip(tokens.documents(texts), ids):
                    if pieces := packer.add(i, blob, sentences):
                        yield _batch(pieces)
        if pieces := packer.pack(True):
            yield _batch(pieces)

    return ordered.mapInArrow(run, PIECES)


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names=_NAMES)
