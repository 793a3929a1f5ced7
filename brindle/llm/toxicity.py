"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, strips accents, and maps homoglyphs, digits and signs that stand for letters to a-z; anything else
becomes a space (or, if a letter, a mark that no term has). Terms are whole words and beginnings of words. Their weights
are the log odds of a document of the label having them, learned from a bounded sample of labelled rows; matches inside
an exception phrase don't count. The sum of a text's weights over the logarithm of its length goes through a logistic
curve fitted on the same sample.

Null and empty texts get the score of a text without matches. Labels that are null and labels without a document are
ignored; without any labelled row nothing matches and all scores are 0. Repeated rows get equal scores, and extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import wider
from brindle.staging import bounded_batches, stage

#: Bounds of the fit: labelled rows, and terms.
FIT_ROWS, TERMS = 8192, 4000
#: A term's least number of toxic documents, least weight, and the lengths of beginnings of words.
SUPPORT, WEIGHT, STEMS = 6, 2.5, range(4, 11)

# Letters that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "s", "æ": "a", "œ": "o", "ø": "o", "đ": "d", "ł": "l", "ð": "d",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Harmless phrases around words that may be terms.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid mistake of mine", "sore loser board")


@lru_cache(1)
def _table() -> np.ndarray:
    """For each code point the ASCII code that it folds to; 0 for marks that vanish."""
    out = np.full(0x110000, ord(" "), np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if i > 127 and not c.isalpha() and not unicodedata.decomposition(c):
            if unicodedata.category(c) in ("Mn", "Cf"):
                out[i] = 0
            continue
        low = unicodedata.normalize("NFKD", c.lower())[:1]
        low = HOMOGLYPHS.get(low, LEET.get(low, low))
        if "a" <= low <= "z":
            out[i] = ord(low)
        elif c.isalpha():
            out[i] = ord("~")
    return out


def fold(text: str | None) -> str:
    """The folded text between two spaces."""
    codes = _table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    return " " + codes[codes > 0].tobytes().decode("ascii") + " "


def terms_of(folded: str) -> set[str]:
    """The terms that a folded text has: its words between spaces, and their beginnings after a space."""
    found = set(folded.split())
    return {f" {w[:n]}" for w in found for n in STEMS if len(w) >= n} | {f" {w} " for w in found if len(w) > 2}


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(h, text, label) of at most FIT_ROWS labelled documents, the first by a hash of doc_id.

    Equal texts of one label count once, so that copies of one document don't weigh its words up.
    """
    rows = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("label")).dropna()
    n = rows.count()
    h = F.md5(F.concat(F.lit("toxic:"), F.col("k").cast("string")))
    unit = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    few = rows.withColumn("h", h).filter(unit < F.lit(1.2 * FIT_ROWS / max(n, 1))).orderBy("h").limit(FIT_ROWS)
    found = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).join(F.broadcast(few), "k")
    found = found.groupBy(F.coalesce("text", F.lit("")).alias("text"), "label").agg(F.min("h").alias("h"))
    return found.select("h", "text", "label")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_pydict(
            {"term": keys, "clean": [counts[0][k] for k in keys], "toxic": [counts[1][k] for k in keys]},
            schema=pa.schema([("term", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]),
        )
        counts[0].clear()
        counts[1].clear()
        return out

    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            counts[1 if label == 1 else 0].update(terms_of(fold(text)))
        if len(counts[0]) + len(counts[1]) > 300_000:
            yield flush()
    yield flush()


def _choose(rows: list) -> dict[str, float]:
    """Terms and weights: the longest form that keeps nine tenths of a beginning's toxic documents, so that a term is
    no wider than its evidence; a longer term goes if a chosen beginning of it weighs about as much."""
    chosen: dict[str, float] = {}
    by_stem: dict[str, list] = {}
    for r in rows:
        for n in STEMS:
            by_stem.setdefault(r["term"][: n + 1], []).append(r)
    for r in sorted(rows, key=lambda r: (len(r["term"].rstrip()), r["term"])):
        term = r["term"]
        stems = [chosen[term[:n]] for n in range(2, len(term) + 1) if term[:n] in chosen]
        if stems and max(stems) >= r["weight"] - 1.0:
            continue
        longer = [x for x in by_stem.get(term, []) if x["term"].startswith(term) and x["toxic"] >= 0.9 * r["toxic"]]
        best = max([r, *longer], key=lambda x: (len(x["term"].rstrip()), -len(x["term"])))
        chosen[best["term"]] = float(best["weight"])
    return chosen


class Lexicon:
    """Terms with weights, exception phrases and the logistic curve."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...], slope: float, offset: float) -> None:
        import ahocorasick

        self.slope, self.offset = slope, offset
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            key = f" {phrase} "
            if key not in terms:
                self.automaton.add_word(key, (len(key), None))
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()

    def feature(self, text: str | None) -> float:
        """The root of the matches' weights over the logarithm of the number of words: the root, so that the first
        term of a text counts most."""
        folded = fold(text)
        if not self.ready:
            return 0.0
        hits, spans = [], []
        for end, (n, weight) in self.automaton.iter(folded):
            (spans if weight is None else hits).append((end - n + 1, end, weight))
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spans)] if spans else hits
        return float(np.sqrt(sum(h[2] for h in hits) / np.log2(4 + folded.count(" ")))) if hits else 0.0

    def score(self, text: str | None) -> float:
        z = self.offset + self.slope * self.feature(text)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> dict:
    """The lexicon's parts, learned from the labelled rows; its size is bounded by TERMS and FIT_ROWS."""
    bounded_batches(docs.sparkSession)
    rows = stage(_labelled(docs, labels, doc_id, text, label), "fit_rows")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not toxic:
        return {"terms": {}, "exceptions": exceptions, "slope": 0.0, "offset": -30.0}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    found = (
        rows.mapInArrow(_count_terms, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= min(SUPPORT, max(1, toxic // 2)))
        .withColumn("weight", odds)
        .filter(F.col("weight") >= WEIGHT)
        .orderBy(F.desc(F.col("toxic") * F.col("weight")), "term")
        .limit(TERMS)
        .collect()
    )
    terms = _choose(found)
    learned = _exceptions(rows, terms)
    model = {"terms": terms, "exceptions": tuple(exceptions) + learned, "slope": 1.0, "offset": 0.0}
    lexicon = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(**lexicon.value)
        for b in batches:
            x = [lex.feature(t) for t in b.column("text").to_pylist()]
            y = [float(v == 1) for v in b.column("label").to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.float64()), "y": pa.array(y, pa.float64())})

    pairs = rows.mapInArrow(features, "x double, y double").collect()  # at most FIT_ROWS
    slope, offset = _logistic(np.array([p["x"] for p in pairs]), np.array([p["y"] for p in pairs]))
    return model | {"slope": slope, "offset": offset}


def _exceptions(rows: DataFrame, terms: dict[str, float]) -> tuple[str, ...]:
    """Phrases of a whole-word term and its next word that clean documents of the sample have and toxic ones don't."""
    whole = {t.strip() for t in terms if t.endswith(" ")}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (f"{x} {y}", int(label == 1))
                for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist())
                for x, y in {p for p in _bigrams(fold(text)) if p[0] in whole}
            ]
            yield pa.RecordBatch.from_pydict(
                {"phrase": pa.array([o[0] for o in out], pa.string()), "toxic": pa.array([o[1] for o in out], pa.int64())}
            )

    found = (
        rows.mapInArrow(pairs, "phrase string, toxic long")
        .groupBy("phrase")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
        .filter("n >= 4 AND toxic = 0")
        .orderBy(F.desc("n"), "phrase")
        .limit(TERMS)
        .collect()
    )
    return tuple(r["phrase"] for r in found)


def _bigrams(folded: str) -> list[tuple[str, str]]:
    w = folded.split()
    return list(zip(w, w[1:]))


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for each whole text; columns of these names
    that ``docs`` has are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*names)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(**shared.value)
        for b in batches:
            s = [lexicon.score(t) for t in b.column(at).to_pylist()]
            extra = [pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, wider(kept.schema, score="double", predicted="int"))
