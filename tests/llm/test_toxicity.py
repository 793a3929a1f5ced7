"""Toxicity scores against a plain search, folding, exceptions, and the fit on odd rows."""

import math

import numpy as np
import pytest

from brindle.llm import toxicity

MODEL = {
    "terms": {" scum ": 3.0, " idio": 4.0, " trash ": 2.5, " awful ": 5.0}, "exceptions": ("trash can", "awful lot of scum"),
    "slope": 2.0, "offset": -1.0,
}


def plain(text, model=MODEL):
    """All places of all terms, those inside an exception left out, one by one."""
    folded = toxicity.fold(text)
    places = lambda s: [i for i in range(len(folded)) if folded.startswith(s, i)]
    covered = [(i, i + len(p) + 2) for p in model["exceptions"] for i in places(f" {p} ")]
    total = sum(
        w for t, w in model["terms"].items() for i in places(t) if not any(a <= i and i + len(t) <= b for a, b in covered)
    )
    x = math.sqrt(total / math.log2(4 + folded.count(" "))) if total else 0.0
    return 1 / (1 + math.exp(-(model["offset"] + model["slope"] * x)))


TEXTS = [
    "you scum", "SCUM scum scum!", "5cum ѕсum s-cum", "idiot idiotic, an idi0t", "trash can and trash", "the trash can", "an awful lot of scum here",
    "awful lot of scum scum", "", None, "   ", "scummy", "ïdiöt", "ścum", "x" * 5000 + " scum", "clean words only", "1diot 1di0tic trash\ncan",
]


def test_scores_equal_a_plain_search(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + d, t) for d, t in documents]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS score", "7 AS predicted", "1 AS label")
    got = {r["doc_id"]: r for r in toxicity.score(df, MODEL).collect()}
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(plain(t), abs=1e-12)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_weights_are_the_sample_s_log_odds(spark):
    rows = [(i, "vile stuff here" if i < 8 else "kind stuff here") for i in range(40)]
    rows = [(i, f"{t} number{i}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    (term,) = model["terms"]
    assert term == " vile"
    assert model["terms"][term] == pytest.approx(math.log(8.5 / 9) - math.log(0.5 / 33))
    spaces = [toxicity.fold(t).count(" ") for _, t in rows[:8]]
    x = np.array([math.sqrt(model["terms"][term] / math.log2(4 + n)) for n in spaces] + [0.0] * 32)
    p = 1 / (1 + np.exp(-(model["slope"] * x + model["offset"])))
    assert p[:8].min() > 0.5 > p[8:].max()
    # the curve is where the likelihood with its small ridge is greatest
    y = np.array([1.0] * 8 + [0.0] * 32)
    assert abs(((y - p) @ x) - 1e-2 * model["slope"]) < 1e-6 and abs((y - p).sum() - 1e-2 * model["offset"]) < 1e-6


def test_fit_on_odd_rows(spark, odd, empty):
    label = [(1, 1), (2, 1), (3, 0), (4, None), (5, 0), (7, 1), (7, 1), (None, 1), (99, 1), (8, 0), (10, 5)]
    labels = spark.createDataFrame(label, "doc_id long, toxic int").selectExpr("*", "'x' AS text", "1 AS h", "2 AS term")
    model = toxicity.fit(odd, labels)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and all(0 <= r["score"] <= 1 for r in scored.collect())
    for docs, own in ((odd, labels.limit(0)), (empty, labels), (empty, labels.limit(0))):
        none = toxicity.fit(docs, own)
        assert none["terms"] == {} and all(r["score"] < 1e-9 for r in toxicity.score(odd, none).collect())
