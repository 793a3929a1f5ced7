"""Spelling variants against brute force: counts, near words, forms and roots."""

import re
import zlib
from collections import Counter

import pytest

from brindle.llm import spelling
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_counts(docs, least=7, count=2, every=31):
    found = Counter()
    for doc_id, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda c: c[0].lower(), word)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def brute_groups(counts, ratio=10):
    letters = sorted({c for w in counts for c in w})

    def edits(w):
        for i in range(len(w) + 1):
            yield from (w[:i] + c + w[i:] for c in letters)
            if i < len(w):
                yield w[:i] + w[i + 1 :]
                yield from (w[:i] + c + w[i + 1 :] for c in letters)

    near = {w: {x for x in edits(w) if x in counts and x != w} for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(((-counts[x], x) for x in xs), default=(0, None))
        form[w] = best[1] if -best[0] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_query_equals_brute_force(spark, documents):
    got = QUERIES["op12_spelling_variants"](spark, SF).select("word", "form", "root", "n", "n_near", "form_n")
    assert rows(got) == brute_groups(brute_counts(documents))


@pytest.mark.parametrize("ratio", [2, 10])
def test_short_words_repeats_and_seams(spark, ratio):
    """Every pair of short words over two letters: all lengths, edits at the seams, runs of one letter, chains of forms."""
    words = {format(i, f"0{k}b").replace("0", "a").replace("1", "é"): 3 ** (i * 7 % 9) for k in range(1, 8) for i in range(2**k)}
    words |= {"aaaaaaaaaaaa": 1, "aaaaaaaaaaa": 30, "aaaaaaaaaa": 900, "×÷": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.group_variants(df, ratio)) == brute_groups(words, ratio)


def test_pairs_come_once(spark):
    words = ["abcdefg", "abcefg", "abccdefg", "aabcdefg", "abcdefgg", "abcdefh", "zbcdefg", "abxdefg"]
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"))
    got = [tuple(sorted((r["word"], r["other"]))) for r in pairs.collect()]
    assert len(got) == len(set(got)) > 0


def test_odd_rows(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for every in (31, None):
        counts = spelling.count_words(odd, 3, 2, every)
        assert rows(counts) == set(brute_counts(docs, 3, 2, every).items())
    assert rows(spelling.group_variants(spelling.count_words(odd, 3, 2))) == brute_groups(brute_counts(docs, 3, 2))
    assert rows(spelling.group_variants(spelling.count_words(empty))) == set()
    with pytest.raises(ValueError):
        spelling.group_variants(spelling.count_words(empty), 1)
