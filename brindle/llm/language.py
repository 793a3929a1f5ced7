"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text tells the longest matches. A text is parsed from left to right into
phrases, each the longest that occurs in the language's text; phrases times log2(length of that text) over the number
of symbols is the cross entropy that the parse estimates, and the language with the least wins.

Texts are lower-cased; letters stay, runs of anything else count as one separator. Every letter of the learned texts is
a symbol of its own, whatever the scripts. Whole texts are parsed. So that numpy steps through many pieces and all
languages at once, texts are first parsed in pieces of ``PIECE`` symbols, as if a phrase began at each; then each piece
is parsed again from where the one before it really ended, until a phrase begins at the same symbol both times, from
which on both parses are the same. Every label that occurs is learned, from a
bounded number of rows and characters, so the model grows with the labels and not with the rows.

A null text and a text without a letter get ``und`` and score 0. Null languages are never learned. With no labelled
text at all every text gets ``und``. Repeated rows get equal results, ties between languages go to the first by name,
and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.text import alone, wider
from brindle.staging import bounded_batches, stage

#: The labelled sample's bounds: rows of each language, characters of a language, and of all languages together, by which
#: each has fewer where very many labels occur. Longer rows come last.
ROWS, CHARS, ALL_CHARS = 48, 20_000, 32_000_000
PIECE = 256
UNKNOWN, SEPARATOR, FIRST = 0, 1, 2
#: States of pieces by languages that are stepped at once.
STEPPED = 1 << 16


def sample(labelled: DataFrame, doc_id: str, text: str, lang: str) -> dict[str, str]:
    """Text of each language from a bounded sample of the labelled rows, chosen by a hash of doc_id."""
    rows = labelled.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = stage(rows.groupBy("lang").agg((F.lit(4.0 * ROWS) / F.count("*")).alias("share")), "label_shares")
    most = max(16, min(CHARS, ALL_CHARS // max(shares.count(), 1)))
    h = F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    unit = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    best = Window.partitionBy("lang").orderBy(F.length("text") > CHARS, "h", "text")  # over a bounded number of rows
    few = (
        rows.join(shares, "lang")
        .withColumn("h", h)
        .filter(unit < F.col("share"))
        .withColumn("k", F.row_number().over(best))
        .withColumn("before", F.sum(F.length("text")).over(best.rowsBetween(Window.unboundedPreceding, -1)))
        .filter((F.col("k") <= ROWS) & (F.coalesce("before", F.lit(0)) < most))
        .select("lang", "k", F.substring("text", 1, most).alias("text"))
    )
    found: dict[str, str] = {}
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["k"])):
        found[r["lang"]] = (found.get(r["lang"], "") + " " + r["text"])[:most]
    return found


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point SEPARATOR, or UNKNOWN if it is a letter."""
    return np.array([UNKNOWN if chr(i).isalpha() else SEPARATOR for i in range(0x110000)], np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Automata:
    """The languages' suffix automata in one sparse table of transitions.

    A state is a place in the table; its transition by a symbol stands ``symbol`` places further on, if that place's
    owner is the state. Otherwise a phrase ends there, and the next one begins with the symbol.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        self.symbols = _kinds().astype(np.int32)
        for k, c in enumerate(letters):
            self.symbols[ord(c)] = FIRST + k
        self.width = FIRST + len(letters)
        tables, roots, at = [], [], 0
        self.bits = np.zeros(len(self.names))
        self.starts = np.zeros((self.width, len(self.names)), np.int64)  # a phrase's state after its first symbol
        for k, name in enumerate(self.names):
            seq = self.encode(texts[name])
            table, states, moves = self._table(self._build(seq.tolist()), at)
            tables.append(table)
            roots.append(states[0])
            self.starts[:, k] = states[0]
            for c, to in moves.items():
                self.starts[c, k] = states[to]
            self.bits[k] = np.log2(len(seq) + 2)
            at += len(table)
        self.roots = np.array(roots, np.int64)
        self.table = np.concatenate(tables)  # owner << 32 | next state; -1 where empty

    def encode(self, text: str) -> np.ndarray:
        s = self.symbols[_codes(text)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != SEPARATOR) | (s[:-1] != SEPARATOR)
        return s[keep]

    @staticmethod
    def _build(seq: list[int]) -> list[dict[int, int]]:
        """The transitions of the suffix automaton of ``seq``."""
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in seq:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
            last = new
        return moves

    def _table(self, moves: list[dict[int, int]], at: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """The table of an automaton that begins at place ``at``, the places of its states, and its root's transitions.

        States are dealt places at random until none of their transitions meets another's, those with many first.
        """
        degree = np.array([len(m) for m in moves])
        rank = np.argsort(-degree, kind="stable")
        own = np.repeat(rank, degree[rank])
        symbol = np.array([c for i in rank.tolist() for c in moves[i]], np.int64)
        to = np.array([s for i in rank.tolist() for s in moves[i].values()], np.int64)
        size = 3 * len(own) + len(moves) + 16
        owner = np.full(size + self.width, -1, np.int64)
        taken = np.zeros(size, bool)
        place = np.full(len(moves), -1, np.int64)
        rng = np.random.RandomState(1)
        ends = np.cumsum(degree[rank])
        many = int((degree > 4).sum())
        for k, i in enumerate(rank[:many].tolist()):
            mine = symbol[ends[k] - degree[i] : ends[k]]
            p = int(rng.randint(size))
            while taken[p] or (owner[p + mine] >= 0).any():
                p = int(rng.randint(size))
            taken[p], place[i], owner[p + mine] = True, p, i
        left = rank[many:]
        first = int(ends[many - 1]) if many else 0
        own_left, symbol_left = own[first:], symbol[first:]
        claim = np.full(len(owner), -1, np.int64)
        while len(left):
            p = rng.randint(size, size=len(left))
            trial = np.full(len(moves), -1, np.int64)
            trial[left] = p
            spots = trial[own_left] + symbol_left
            claim[spots] = own_left
            clash = np.zeros(len(moves), bool)
            clash[own_left[(owner[spots] >= 0) | (claim[spots] != own_left)]] = True
            claim[p] = left
            clash[left[taken[p] | (claim[p] != left)]] = True
            placed = left[~clash[left]]
            place[placed] = trial[placed]
            taken[trial[placed]] = True
            good = ~clash[own_left]
            owner[spots[good]] = own_left[good]
            left, own_left, symbol_left = left[clash[left]], own_left[~good], symbol_left[~good]
        place += at
        table = np.full(len(owner), -1, np.int64)
        table[place[own] - at + symbol] = place[own] << 32 | place[to]
        return table, place, moves[0]

    def _step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and where a new phrase begins with it."""
        move = self.table.take(state + symbol)
        miss = (move >> 32) != state
        move &= 0xFFFFFFFF
        if lang is None:  # [piece, language]
            np.copyto(move, self.starts.take(symbol[:, 0], axis=0), where=miss)
        else:
            move[miss] = self.starts[symbol[miss], lang[miss]]
        return move, miss

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language]: the number of phrases of each encoded text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.repeat((sizes > 0).astype(np.int64)[:, None], len(self.names), axis=1)
        pieces = -(-sizes // PIECE)
        n = int(pieces.sum())
        if not n:
            return out
        seq = np.concatenate(texts)
        text = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * PIECE
        length = np.minimum(PIECE, sizes[text] - nth * PIECE)
        chunk = max(1, STEPPED // len(self.names))
        carried = self.roots
        for at in range(0, n, chunk):
            part = slice(at, at + chunk)
            places = np.minimum(begin[part][:, None] + np.arange(PIECE), len(seq) - 1)
            found, carried = self._chunk(seq[places], length[part], nth[part] == 0, carried)
            np.add.at(out, text[part], found)
        return out

    def _chunk(self, lanes: np.ndarray, length: np.ndarray, first: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[piece, language]: how many phrases begin inside each of these consecutive pieces (or at its first symbol, if
        that ends the phrase before), and the states at the end of the last one."""
        order = np.argsort(-length, kind="stable")
        steps = np.ascontiguousarray(lanes[order].T)[:, :, None]
        longer = len(order) - np.searchsorted(length[order][::-1], np.arange(PIECE), "right")
        now = np.tile(self.roots, (len(order), 1))
        missed = np.zeros((PIECE, *now.shape), bool)
        for t, k in enumerate(longer.tolist()):  # the first k pieces have a symbol here
            if not k:
                break
            move, miss = self._step(now[:k], steps[t, :k])
            inverse = order[:k]
            missed[t, inverse] = miss
            now[:k] = move
        end = np.empty_like(now)
        end[order] = now
        own_end = end.copy()
        count = missed.sum(axis=0)
        own = count.copy()
        used = np.full_like(end, -1)  # the states that pieces were parsed from
        while True:
            before = np.vstack([carried[None], end[:-1]])
            piece, lang = np.nonzero((before != used) & ~first[:, None])
            if not len(piece):
                return count, end[-1]
            used[piece, lang] = before[piece, lang]
            more, last = self._again(lanes, length, missed, piece, lang, before[piece, lang])
            count[piece, lang] = own[piece, lang] + more
            end[piece, lang] = np.where(last < 0, own_end[piece, lang], last)

    def _again(self, lanes, length, missed, piece, lang, state) -> tuple[np.ndarray, np.ndarray]:
        """Parse pieces from other states: how many phrases more begin, and the last state, or -1 if both parses meet."""
        more, last = np.zeros(len(piece), np.int64), np.full(len(piece), -1, np.int64)
        left = np.arange(len(piece))
        for t in range(PIECE):
            p, k = piece[left], lang[left]
            state, miss = self._step(state, lanes[p, t], k)
            then = missed[t, p, k]
            more[left] += miss.astype(np.int64) - then
            apart = ~(miss & (then | (t == 0)))
            done = apart & (length[p] == t + 1)
            last[left[done]] = state[done]
            apart &= ~done
            left, state = left[apart], state[apart]
            if not len(left):
                break
        return more, last

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        coded = [self.encode(t or "") for t in texts]
        found = self.phrases(coded)
        result = []
        for code, row in zip(coded, found):
            if not (code != SEPARATOR).any():
                result.append(("und", 0.0))
                continue
            rate = row * self.bits / len(code)
            best = int(rate.argmin())
            rest = np.delete(rate, best)
            second = float(rest.min()) if len(rest) else 2 * float(rate[best])
            result.append((self.names[best], second / (second + float(rate[best]))))
        return result


_MODEL: dict = {}


def _automata(texts: dict[str, str]) -> Automata:
    """Built once in each Python worker."""
    made = alone(_MODEL)
    if made.get("texts") != texts:
        made.clear()
        made.update(texts=texts, automata=Automata(texts))
    return made["automata"]


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language learned from ``labelled`` that fits the text best.

    Columns of these names that ``docs`` has are replaced. Null texts, texts without a letter and, where no label was
    learned, all texts are ``und`` with score 0.

    ``score`` is the second best language's entropy over the sum of the two best's: 0.5 for a tie, near 1 when sure.
    """
    return _identified(docs, sample(labelled, doc_id, text, lang), text)


def _identified(docs: DataFrame, learned: dict[str, str], text: str) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learned)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*names)
    schema = wider(kept.schema, lang_pred="string", score="double")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = model.value
        for b in batches:
            values = b.column(at).to_pylist()
            found = _automata(texts).identify(values) if texts else [("und", 0.0)] * len(values)
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def keep_identified(
    docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The documents whose language can be told: those with ``und`` go. Columns as in ``docs``, whatever their names.

    Where no label was learned nothing can be told apart, and every document with a letter stays.
    """
    learned = sample(labelled, doc_id, text, lang)
    if not learned:
        return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    found = _identified(docs.select(row, F.col(text).alias(text)), learned, text)
    kept = found.filter("lang_pred <> 'und'")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
