"""The packing programme is the optimum over every boundary of tokenized documents, and copies are told apart."""

import numpy as np
import pytest

from brindle.llm import packing
from brindle.llm.queries import tokenizer_path


def cheapest(places, costs, length):
    """Least cost of cutting at the offered places, by trying all beginnings of each sequence."""
    at, best = [0, *places], [0]
    near = at[-1] - length
    for j in range(1, len(at)):
        ways = [best[i] + length - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= length]
        ways += [
            best[i] + packing.SHORT_COST
            for i in range(j)
            if at[j] - at[i] in packing.POWERS or at[j] >= near and at[j] - at[i] in packing.TAIL_POWERS
        ]
        best.append(min(ways) + costs[j - 1])
    return best[-1]


def cost_of(cuts, places, costs, length):
    total, before = 0, 0
    at = dict(zip(places, costs, strict=True))
    for c in cuts:
        size = c - before
        short = size in packing.POWERS or c >= places[-1] - length and size in packing.TAIL_POWERS
        total += at[c] + (min(packing.SHORT_COST, length - size) if short else length - size)
        before = c
    return total


@pytest.mark.parametrize("every", [5, 6, 12, 20, 90])
def test_all_sentence_ends_are_offered(every):
    tokens = packing.word_tokens(tokenizer_path())
    rng = np.random.default_rng(every)
    texts = []
    for _ in range(60):
        words = ["word"] * int(rng.integers(20, 400))
        for i in range(every, len(words), every):
            words[i - int(rng.integers(0, 3))] = "end."
        texts.append(" ".join(words))
    docs = tokens.documents(texts)
    sizes = np.array([len(ids) // 4 for ids, _ in docs])
    ends = np.cumsum(sizes)
    sentences = np.concatenate([s + e - n for (_, s), e, n in zip(docs, ends, sizes, strict=True)])
    places, costs = packing.offered_cuts(sentences, ends)
    assert set(sentences.tolist()) <= set(places.tolist()) | set((ends - 1).tolist())
    places, costs = packing.with_tail(places, costs)
    cuts = packing.best_cuts(places.tolist(), costs.tolist(), True)
    assert cost_of(cuts, places.tolist(), costs.tolist(), packing.LENGTH) == cheapest(places.tolist(), costs.tolist(), packing.LENGTH)


def test_copies_of_a_document_are_told_apart(spark):
    rows = [(1, "one two three."), (1, "one two three."), (2, "x"), (None, "n"), (None, None), (1, "zz")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    keys = [(r["doc_id"], r["copy"], r["start"]) for r in got]
    assert len(keys) == len(set(keys)) and {k[:2] for k in keys} == {(1, 0), (1, 1), (1, 2), (2, 0), (None, 0), (None, 1)}
