"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import staging
from brindle.llm import brown, fingerprints, fmindex, graph, language, mixing, neardup, packing, pages, quality, substrings, toxicity
from brindle.llm.queries import tokenizer_path

MODEL = {"terms": {" idiot": 5.0, " scum ": 4.0}, "exceptions": ("scum line",), "slope": 4.0, "offset": -4.0}
OPERATORS = {
    "quality": lambda d: quality.judge(d),
    "packing": lambda d: packing.pack(d, tokenizer_path()),
    "pages": lambda d: pages.extract(d.drop("text").withColumn("html", F.lit(None).cast("string"))),
    "neardup": lambda d: neardup.near_duplicates(d),
    "brown": lambda d: brown.score(d, brown.train(d, 1)),
    "substrings": lambda d: substrings.removals(d),
    "fingerprints": lambda d: fingerprints.compare_with_next(d),
    "mixing": lambda d: mixing.plan_mix(d),
    "language": lambda d: language.identify(d, d),
    "toxicity": lambda d: toxicity.score(d, MODEL),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == 12 if name != "packing" else len(rows) >= 12


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_quality_of_odd_rows(odd):
    got = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert (got[8]["n_repeat_words"], got[8]["n_words"]) == (50, 50) and got[8]["base_failed"]
    assert got[9]["n_symbols"] == 3


def test_quality_host_verdict(spark):
    good = "this text has quite a few different words in it and so passes all the rules"
    rows = [(i, "x", "bad") for i in range(60)] + [(100, good, "bad")] + [(200 + i, good, f"h{i % 3}") for i in range(90)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[100] and got[200] and not got[0]


def test_mix_repeats_rows(spark):
    rows = [(i, f"a{i} b c d", "s" if i < 4 else "t") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan_mix(df).collect()}
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert words == {k: v for k, v in plan.items() if v}
    assert max(plan.values()) <= 12


def test_water_filling_caps(spark):
    df = spark.createDataFrame([("0a", 10, 1), ("0b", 1, 2), ("0c", 100, 3)], "skey string, source_size long, weight int")
    level = mixing.water_level(df, 3)
    assert level * 1 + 3 + level * 3 == pytest.approx(111) and level * 2 > 3


def test_near_duplicates_of_odd_rows(odd):
    got = [(r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in neardup.near_duplicates(odd).collect()]
    assert (6, 5, False) in {g[:3] for g in got} and (2, 2, True, 0) in got and (3, 3, True, 0) in got
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_null_and_repeated_ids_with_different_texts(spark):
    rng = np.random.RandomState(10)
    texts = [" ".join(f"w{x}" for x in rng.randint(0, 900, 40)) for _ in range(14)]
    rows = [(None, t) for t in texts[:6]] + [(5, texts[0]), (6, texts[5] + " more"), (7, texts[6]), (7, texts[7])]
    rows += [(8, texts[8]), (8, texts[9]), (9, texts[9]), (3, texts[8]), (None, texts[1]), (10, texts[10]), (10, texts[10])]
    rows += [(11, texts[11]), (11, texts[11] + " end"), (12, texts[12]), (None, None), (12, ""), (13, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (2, 5):
        sets = [set(neardup.shingles(t, width).tolist()) for _, t in rows]
        group = list(range(len(rows)))
        for i, a in enumerate(sets):
            for k, b in enumerate(sets[:i]):
                if a and 100 * len(a & b) >= 80 * len(a | b):
                    group = [group[k] if g == group[i] else g for g in group]
        got = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df, width).collect()]
        for g in set(group):
            mine = [r for r, x in zip(rows, group) if x == g]
            left = [r for r in got if r in mine]
            assert len(left) == 1 and (left[0][0] or 0) == min(i or 0 for i, _ in mine)
        assert len(got) == len(set(group))


@pytest.mark.parametrize("block", [2, 192])
def test_chain_of_near_copies(spark, monkeypatch, block):
    """Neighbours are linked, ends are not: one component, by links between different texts, in any blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        w = list(words)
        for j in range(8 * k):
            w[j * 2 % 200] = f"z{j}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(neardup.shingles(t, 2).tolist()) for _, t in rows]
    near = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:])]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 2).collect()}
    expected, least = {}, 0
    for k in range(12):
        if k and near[k - 1] < 0.8:
            least = k
        expected[k] = least
    assert got == expected


def test_sketch_estimates():
    rng = np.random.RandomState(1)
    pool = np.unique(rng.randint(0, 1 << 62, 3000).astype(np.uint64))
    for share in (0.3, 0.8, 0.95):
        n = 1000
        common = int(2 * n * share / (1 + share))
        a, b = pool[:n], pool[n - common : 2 * n - common]
        r = neardup.registers([a, b])
        assert neardup.estimate(r[0], r[1], n, n) == pytest.approx(share, abs=0.1)
    merged = neardup.registers([pool[:500], pool[500:900], pool[:900]])
    assert (np.maximum(merged[0], merged[1]) == merged[2]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3), (200, 150), (150, 175)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100 and got[200] == got[175] == 150


def test_few_edges_are_written_by_few_tasks(spark, monkeypatch):
    """However many partitions shuffles have; with the star's neighbours broadcast and shuffled alike."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(100) if i % 5 != 4], "u long, v long")
    files = {}

    def noted(df, name, codec=None, write=staging.stage):
        found = write(df, name, codec)
        files.setdefault(name, []).append(len(found.inputFiles()))
        return found

    for module in (staging, graph):
        monkeypatch.setattr(module, "stage", noted, raising=False)
    own = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        for rows in (graph.BROADCAST_ROWS, 0):
            monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
            got = {r["node"]: r["comp"] for r in graph.components(edges).collect()}
            assert got == {i: i // 5 * 5 for i in range(100)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files["star"] + files["least"]) <= staging.FEWEST_TASKS


def test_fm_index_counts():
    rng = np.random.RandomState(2)
    text = np.append(rng.randint(1, 6, 5000), 0)
    index = fmindex.FMIndex(text, 6, 4)
    windows = np.lib.stride_tricks.sliding_window_view(text[:-1], 4)
    patterns = rng.randint(1, 6, (200, 4))
    low, high = index.search(patterns)
    assert [int(h - l) for l, h in zip(low, high)] == [int((windows == p).all(axis=1).sum()) for p in patterns]


def test_hot_minimizers_go_by_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", 2)
    monkeypatch.setattr(substrings, "SHARD_SYMBOLS", 60)
    rng = np.random.RandomState(3)
    line = "licensed under the terms of a licence that all of the texts here have at their end"
    rows = [(i, " ".join(f"v{x}" for x in rng.randint(0, 50, 30)) + " " + line + f" u{i % 7} " + line) for i in range(40)]
    seen, expected = set(), {}
    for i, t in rows:
        w, gone = t.split(), set()
        for s in range(len(w) - 19):
            if tuple(w[s : s + 20]) in seen:
                gone |= set(range(s, s + 20))
            seen.add(tuple(w[s : s + 20]))
        expected[i] = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept_sha256"] for r in substrings.removals(df).collect()} == expected


def test_substrings_of_odd_rows(odd):
    got = {r["doc_id"]: r for r in substrings.removals(odd).collect()}
    assert got[6]["n_removed"] == got[6]["n_words"] == 30_000 and got[8]["n_removed"] == 49
    assert got[2]["n_words"] == 0
    named = odd.withColumn("begins", F.lit(1)).withColumn("mark", F.lit(2))
    assert substrings.remove_repeats(named).filter("begins = 1 AND mark = 2").count() == 12
    kept = substrings.remove_repeats(odd)
    assert kept.columns == odd.columns and {r["doc_id"]: r["text"] for r in kept.collect()}[4] == " \n\t "


def test_best_cuts_by_brute_force():
    rng = np.random.RandomState(4)
    for _ in range(30):
        places = np.unique(rng.randint(1, 60, 14)).tolist()
        places = [p for k, p in enumerate([0, *places]) if k]
        costs = rng.randint(0, 9, len(places)).tolist()
        if max(np.diff([0, *places])) > 16:
            continue
        at = [0, *places]
        best = [0] + [10**9] * len(places)
        for j in range(1, len(at)):
            for i in range(j):
                if at[j] - at[i] <= 16:
                    best[j] = min(best[j], best[i] + 16 - (at[j] - at[i]) + costs[j - 1])
        cuts = packing.best_cuts(places, costs, True, 16)
        inner = [0, *cuts]
        paid = sum(16 - (b - a) + costs[places.index(b)] for a, b in zip(inner, inner[1:]))
        assert paid == best[-1]


def test_last_tokens_end_in_powers_of_two():
    """Padding of a partition's end stays below a step and a few cuts, whatever its length."""
    for total in (100, 4095, 4097, 5000, 20_011, 50_077):
        packer = packing.Packer(0)
        pieces = packer.add(1, b"\1\0\0\0" * total, np.zeros(0, np.int64)) + packer.pack(True)
        assert sum(p[2] for p in pieces) == total and [p[1] for p in pieces] == np.cumsum([0, *(p[2] for p in pieces)])[:-1].tolist()
        padding = sum(0 if p[2] & (p[2] - 1) == 0 else 4096 - p[2] for p in pieces)
        assert padding <= 64 * len(pieces) or total < 4096
        assert all(p[2] >= 64 for p in pieces) or total < 128


def test_word_tokens_match_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    tokens = packing.WordTokens(tokenizer_path())
    for text in ("It's NOT so... _x_ a1b2 don't!! (é) ÉÀ. ß—x  'tis ’ll \x00z", "***&&& ab@cd.ef ﬁ İI 文字。ab", "", "a" * 300, "é. ß!? naïve' über're ñ'",
                 "été, cióng... é_ ß\\ a\u0301b, e\u0301t\u00e9. Ωmega! ΑΣ, ǅ. \u2028é. é\u00a0a."):
        ids = np.frombuffer(tokens.documents([text])[0][0], "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids + [2]


def _letters(rng, n):
    return "".join(chr(97 + x) for x in rng.randint(0, 26, n))


def test_fingerprint_likeness():
    rng = np.random.RandomState(5)
    text = _letters(rng, 4000)
    moved = "zz" * 20 + text
    a, b = fingerprints.sketch(text), fingerprints.sketch(moved)
    assert fingerprints.likeness(a, b) > 0.8 and fingerprints.likeness(a, a) == 1.0
    assert fingerprints.likeness(fingerprints.sketch(""), fingerprints.sketch("")) == 1.0
    assert fingerprints.likeness(fingerprints.sketch(""), a) == 0.0 and len(fingerprints.sketch("ab")) == 1
    assert (fingerprints.read(fingerprints.written(a)) == a).all()
    at, _ = fingerprints.anchors(text)
    inside, _ = fingerprints.anchors(text[100:2000])
    assert set((inside + 100).tolist()) == {p for p in at.tolist() if 100 <= p <= 2000 - fingerprints.K}


def test_closed_syncmers_by_brute_force():
    rng = np.random.RandomState(12)
    for text in (_letters(rng, 900), "ab" * 200, "été naïve 文字 😀 " * 30):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        inner = []
        for k in range(len(codes) - fingerprints.S + 1):
            h = np.uint64(0)
            for c in codes[k : k + fingerprints.S]:
                h = h * fingerprints._STEP + c
            inner.append(int(fingerprints._mixed(np.array([h]))[0]))
        expected = []
        for k in range(len(codes) - fingerprints.K + 1):
            own = inner[k : k + fingerprints.K - fingerprints.S + 1]
            if min(own) in (own[0], own[-1]):
                expected.append(k)
        at, h = fingerprints.anchors(text)
        assert at.tolist() == expected
        for x, y in zip(at.tolist(), h.tolist()):  # an anchor's hash is that of its text
            assert {int(v) for p, v in zip(at, h) if text[p : p + fingerprints.K] == text[x : x + fingerprints.K]} == {y}


def test_likeness_by_brute_force():
    rng = np.random.RandomState(13)
    base = _letters(rng, 6000)
    texts = [base, base[:3000], base[3000:] + base[:3000], _letters(rng, 500) + base[1000:1400] + _letters(rng, 900), base[:40], "abc" * 400, _letters(rng, 5000)]
    marks = [fingerprints.sketch(t) for t in texts]

    def naive(a, b):
        top = []
        for m in (a, b):
            values = sorted(set(m[:, 0].tolist()))
            top.append(max(fingerprints.SHARE - 1, values[-1]) if len(values) >= fingerprints.LEAST else 1 << 32)
        seen, sides = {}, []
        for m in (a, b):
            seen, own = {}, []
            for h, p in m.tolist():
                if h <= min(top):
                    own.append(((h, seen.get(h, 0)), p))
                    seen[h] = seen.get(h, 0) + 1
            sides.append(own)
        there = dict(sides[1])
        pairs = sorted((p, there[k] - p) for k, p in sides[0] if k in there)
        n = 0
        for i, (_, d) in enumerate(pairs):
            around = [0] + [pairs[j][1] for j in (i - 1, i + 1) if 0 <= j < len(pairs)]
            n += any(abs(d - x) <= fingerprints.TOLERANCE for x in around)
        return n / (len(sides[0]) + len(sides[1]) - n)

    for a in marks:
        for b in marks:
            assert fingerprints.likeness(a, b) == pytest.approx(naive(a, b))
    assert fingerprints.likeness(marks[0], marks[2]) > 0.9  # moved as a whole
    assert fingerprints.likeness(marks[0], marks[6]) == 0 and fingerprints.likeness(marks[0], marks[3]) > 0.01


def test_long_texts_show_short_shared_passages():
    rng = np.random.RandomState(14)
    shared = _letters(rng, 600)
    a, b = (_letters(rng, 60_000) + shared + _letters(rng, 60_000) for _ in range(2))
    assert fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b)) > 0


def test_short_texts_have_fingerprints():
    rng = np.random.RandomState(11)
    texts = ["".join(chr(97 + x) for x in rng.randint(0, 26, n)) for n in range(14, 40) for _ in range(40)]
    found = [fingerprints.sketch(t) for t in texts]
    assert all(len(f) for f in found)
    assert all(fingerprints.likeness(a, b) == 0 for a, b in zip(found, found[1:]))
    assert all(fingerprints.likeness(f, fingerprints.sketch("")) == 0 for f in found)


def test_language_of_odd_rows(odd):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, odd).collect()}
    assert got[2] == got[3] == got[4] == got[9] == ("und", 0.0) and got[1][0] == "en"
    kept = language.keep_identified(odd, odd)
    assert kept.dtypes == odd.dtypes and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 5, 6, 7, 7, 8, 10]


def test_phrases_are_longest_matches():
    texts = {"x": "abcabd", "y": "zzz"}
    model = language.Automata(texts)
    got = model.phrases([model.encode(t) for t in ("abcabd", "abdabc", "q", "", "abq")])
    assert got[:2, 0].tolist() == [1, 2] and got[3, 0] == 0


def _scripts() -> tuple[dict[str, str], dict[str, str]]:
    """Learned and other texts of two Han-script languages that share all letters, among many scripts below them."""
    rng = np.random.RandomState(8)
    texts = {}
    for name, low, high in (("la", 97, 123), ("cy", 0x430, 0x450), ("ar", 0x621, 0x64B), ("hi", 0x905, 0x93A), ("ja", 0x3041, 0x30FB), ("am", 0x1200, 0x1249)):
        texts[name] = "".join(chr(x) for x in rng.randint(low, high, 3000))
    han = [chr(0x4E00 + x) for x in range(300)]
    words = {k: ["".join(rng.choice(han, 3)) for _ in range(100)] for k in ("zh", "yue")}
    learned = texts | {k: "".join(rng.choice(w, 900)) + "".join(han) for k, w in words.items()}
    return learned, {k: "".join(rng.choice(w, 20)) for k, w in words.items()}


def test_every_letter_is_a_symbol():
    learned, others = _scripts()
    assert len({c for t in learned.values() for c in t if c.isalpha()}) > 500
    model = language.Automata(learned)
    for name, text in others.items():
        found, score = model.identify([text])[0]
        assert found == name and score > 0.6


@pytest.mark.parametrize(("piece", "stepped"), [(256, 1 << 16), (16, 64)])
def test_phrases_by_brute_force(monkeypatch, piece, stepped):
    """In whatever pieces: long phrases run over many of them, and unknown letters end them."""
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "STEPPED", stepped)
    learned, others = _scripts()
    model = language.Automata(learned)
    texts = [*others.values(), learned["hi"][50:400] + " qя " + learned["zh"][:300], "한", "é", "", learned["cy"][7:]]
    got = model.phrases([model.encode(t) for t in texts])
    for row, text in zip(got, texts):
        coded = model.encode(text).tolist()
        for k, name in enumerate(model.names):
            whole, n = model.encode(learned[name]).astype("<u4").tobytes(), 0
            now, n = b"", int(len(coded) > 0)
            for c in coded:
                c = np.uint32(c).tobytes()
                longer = [whole.find(now + c)]
                while longer[-1] >= 0 and longer[-1] % 4:
                    longer.append(whole.find(now + c, longer[-1] + 1))
                if longer[-1] >= 0:
                    now += c
                else:
                    n, now = n + 1, c if c in {whole[i : i + 4] for i in range(0, len(whole), 4)} else b""
            assert row[k] == n


def test_every_label_is_learned(spark):
    rng = np.random.RandomState(9)
    words = {f"l{k:02d}": ["".join(chr(97 + x) for x in rng.randint(0, 26, 5)) for _ in range(12)] for k in range(80)}
    rows = [(3 * k + j, " ".join(rng.choice(w, 40)), n) for k, (n, w) in enumerate(words.items()) for j in range(3 if k < 70 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df, df).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == r["lang"] for r in got)


def test_toxicity_folding_and_exceptions(spark):
    texts = ["you ｉdiot", "1D10T!", "іdіоt", "IDIÓTS", "the scum line is clean", "scum", "scummy", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, MODEL).collect()}
    assert [got[k] for k in range(9)] == [1, 1, 1, 1, 0, 1, 0, 0, 0]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).first()["predicted"] == 0


@pytest.mark.parametrize(("core", "listed", "together", "block"), [(8192, 1 << 17, 1 << 20, 1 << 18), (4, 8, 3, 40)])
def test_class_model_by_brute_force(spark, monkeypatch, core, listed, together, block):
    """Scores from the vocabulary's classes, word by word; the known words and one unknown one of each ending share 1."""
    for name, value in (("CORE", core), ("LISTED", listed), ("TOGETHER", together), ("BLOCK", block)):
        monkeypatch.setattr(brown, name, value)
    rng = np.random.RandomState(6)
    words = ["der", "die", "haus", "the", "house", "is", "maus", "mice", "und", "and", "rar,", "x9"]
    share = np.arange(len(words), 0, -1) / sum(range(len(words) + 1))
    texts = [" ".join(rng.choice(words, 20, p=share)) for _ in range(60)] + ["rare words", None, "RARE thing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = brown.train(docs, 2)
    vocabulary = {r["h"]: (r["n"], r["cls"]) for r in brown.vocabulary(model).collect()}
    known = {w: vocabulary[brown.word_hash(w.encode())] for w in {w for t in texts for w in brown.tokens(t)} for w in [w.decode()]}
    first = model["learned"] + 1
    assert all(c < first if n >= brown.MIN_COUNT or core > 8 else c >= first for n, c in known.values())
    table = np.zeros((first + brown.ENDINGS,) * 2)
    for t in texts:
        before = model["learned"]
        for w in [*brown.tokens(t), None]:
            cls = model["learned"] if w is None else known[w.decode()][1]
            table[before, cls] += 1
            before = cls
    assert (table == model["table"]).all()
    n_all = sum(n for n, _ in known.values()) + len(texts)
    z = n_all + len(known) + 1 + 1
    mass = table.sum(axis=0)
    own = (mass + 1) / (mass.sum() + len(table))
    sums = {c: (sum(n for n, k in known.values() if k == c), sum(k == c for _, k in known.values())) for c in range(len(table))}

    def probability(word, before):
        n, c = known.get(word, (0, first + brown.ending((word or "").encode())))
        if word is None:
            n, c = len(texts), model["learned"]
        step = (table[before, c] + 2 * own[c]) / (table[before].sum() + 2)
        inside = 1 if word is None else n / sums[c][0] if c < first else (n + 1) / (sums[c][0] + sums[c][1] + 1)
        return 0.95 * step * inside + 0.05 * (n + 1) / z, c

    asked = [*texts[:20], "the unknown, thing", None, "is is is"]
    found = {r["doc_id"]: r for r in brown.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(asked):
        total, before, tokens = 0.0, model["learned"], [w.decode() for w in brown.tokens(t)]
        for w in [*tokens, None]:
            p, before = probability(w, before)
            total += np.log10(p)
        assert found[k]["score"] == pytest.approx(total) and found[k]["n_known"] == 1 + sum(w in known for w in tokens)
    every = [*known, None, *("qq" + chr(97 + x) + m for x in range(26) for m in ("", ",")), "qqé", "qqé,", "qq9"]
    for before in {c for _, c in known.values()} | {model["learned"]}:
        assert sum(probability(w, before)[0] - 0.05 / z * (w not in known and w is not None) for w in every) <= 1 + 1e-9


def test_best_classes_gain_most():
    rng = np.random.RandomState(7)
    table = rng.randint(0, 50, (9, 9)).astype(float)
    word = np.repeat([0, 1, 2], [3, 1, 4])
    sides = [(word, np.array([0, 3, 8, 2, 1, 4, 5, 8]), rng.randint(1, 6, 8).astype(float)) for _ in range(2)]

    def likelihood(g):
        return brown._phi(g).sum() - brown._phi(g.sum(axis=0)).sum() - brown._phi(g.sum(axis=1)).sum()

    for w, chosen in enumerate(brown.best_classes(table, 5, *sides, 3).tolist()):
        gains = []
        for c in range(5):
            if table[c].sum() < table[:5].sum() / 5 / brown.SMALL:
                continue
            parts = np.zeros(5)
            row, column = np.zeros(9), np.zeros(9)
            for target, (ws, cs, xs) in zip((row, column), sides):
                np.add.at(target, cs[ws == w], xs[ws == w])
            g_row, g_column = table[c] + row, table[:, c] + column
            parts = brown._phi(g_row).sum() - brown._phi(table[c]).sum() + brown._phi(g_column).sum() - brown._phi(table[:, c]).sum()
            parts -= brown._phi(g_row.sum()) - brown._phi(table[c].sum()) + brown._phi(g_column.sum()) - brown._phi(table[:, c].sum())
            gains.append(parts)
        assert gains[chosen] == pytest.approx(max(gains))


def test_words_beyond_the_core_are_clustered(spark, monkeypatch):
    """Words beyond the core that stand among the same neighbours come to the classes of core words that do."""
    monkeypatch.setattr(brown, "CORE", 40)
    rng = np.random.RandomState(8)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]
    texts = [" ".join(kinds[j % 3][min(39, int(rng.exponential(9)))] for j in range(60)) for _ in range(300)]
    model = brown.train(spark.createDataFrame([(t,) for t in texts], "text string"), 12)
    rows = brown.vocabulary(model).orderBy(F.desc("n"), "h").collect()
    kind = {brown.word_hash(w.encode()): k for k, ws in enumerate(kinds) for w in ws}
    votes = {}
    for r in rows[:40]:
        votes.setdefault(r["cls"], []).append(kind[r["h"]])
    beyond = [r for r in rows[40:] if r["n"] >= brown.MIN_COUNT]
    right = [max(set(v), key=v.count) == kind[r["h"]] for r in beyond if (v := votes.get(r["cls"]))]
    assert len(right) > 20 and np.mean(right) > 0.8
