"""The pipeline's chain against a plain version on a small fixture, and each stage on odd and on empty tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing, packing
from brindle.llm.queries import tokenizer_path

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    """Near copies, repeated passages, a text without letters, three sources, four languages of the smallest tables' kind."""
    passage = " ".join(f"shared{i}" for i in range(30))
    base = " ".join(f"base{i}" for i in range(120))
    texts = [
        base, base.replace("base60 ", "other "), f"one two {passage} three four", f"five {passage} six seven eight", "12 34 !! 56",
        " ".join(f"w{i}" for i in range(60)), f"{passage}", "a short one.", "another short text here.", None, "", base,
        " ".join(f"x{i % 25}" for i in range(90)), "the end of it all.",
    ]
    return [(i * 3 + 1, t, ("en", "de")[i % 2], "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_chain(rows):
    """(doc_id, words) after language identification, near and substring deduplication."""
    rows = [(d, WORD.findall(t)) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    sets = {d: shingles([w.lower() for w in words]) for d, words in rows}
    group = {d: d for d, _ in rows}
    ids = sorted(group)
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    rows = sorted((d, w) for d, w in rows if group[d] == d)
    seen, out = set(), []
    for d, words in rows:
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        out.append((d, [w for i, w in enumerate(words) if i not in gone]))
    return out


def test_chain_equals_the_plain_version(spark):
    import corpus_pipeline

    rows = fixture()
    docs = spark.createDataFrame(rows, DOCS)
    for _, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, SF)
    got = [(r["doc_id"], WORD.findall(r["text"])) for r in docs.orderBy("doc_id").collect()]
    want = plain_chain(rows)
    assert got == want and len(want) == 7 and sum(len(w) for _, w in want) < sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    # mixing: what each document gives is what the plan (which SQL checks) takes of it, repeated whole and in part
    plan = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.plan_mix(docs).collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert mixed.columns == docs.columns
    taken = defaultdict(list)
    for r in mixed.collect():
        taken[r["doc_id"]].append(WORD.findall(r["text"]))
    own = dict(want)
    for d, (size, n) in plan.items():
        copies = sorted(taken.get(d, []), key=len, reverse=True)
        assert size == len(own[d]) and sum(map(len, copies)) == n
        assert all(c == own[d] for c in copies[: n // size if size else 0]) and all(c == own[d][: len(c)] for c in copies)
    # packing: the pieces of each copy are its tokens, in sequences without gaps
    pieces = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    tokens = packing.WordTokens(tokenizer_path())
    ids = {(d, i): blob for d, texts in taken.items() for i, (blob, _) in enumerate(tokens.documents(sorted(" ".join(t) for t in texts)))}
    by_copy, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_copy[p["doc_id"], p["copy"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_copy) == set(ids)
    for key, parts in by_copy.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            raw = np.frombuffer(ids[key], "<u4")[at : at + p["length"]].tobytes()
            assert p["start"] == at and zlib.crc32(raw) == p["ids_crc32"]
            at += p["length"]
        assert 4 * at == len(ids[key])
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [0, *np.cumsum([p["length"] for p in parts]).tolist()[:-1]]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, empty, number):
    import corpus_pipeline

    name, step = corpus_pipeline.STAGES[number]
    out = step(spark, odd, SF)
    rows = out.collect()
    assert step(spark, empty, SF).count() == 0
    if number == 4:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
        return
    assert out.columns == odd.columns
    texts = sorted((r["text"] or "" for r in odd.collect()), key=len)
    if name == "language_id":
        assert len(rows) == sum(any(c.isalpha() for c in t) for t in texts)
    if name == "near_dedup":  # the two long texts are one group, the repeated row is one
        assert len(rows) == len(texts) - 2
    if name == "substring_dedup":
        assert len(rows) == len(texts) and sum(len(r["text"] or "") > 10_000 for r in rows) == 1
    if name in ("substring_dedup", "mix_sources"):
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)


def test_a_corpus_without_labels_is_kept(spark):
    import corpus_pipeline

    rows = spark.createDataFrame(fixture(), DOCS).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.STAGES[0][1](spark, rows, SF)
    assert kept.count() == 11
