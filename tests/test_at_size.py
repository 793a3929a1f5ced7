"""What larger tables do to a plan, shown on small ones."""

import pytest
from pyspark.sql import functions as F

from brindle.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture
def conf(spark):
    """Sets the session's settings for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def test_enhancement_joins_by_shuffle_where_no_side_is_small(spark, conf):
    def rows():
        return sorted(map(tuple, q.QUERIES["enhance_tracks"](spark, SF).collect()))

    small = rows()
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert rows() == small


def test_index_finds_phrases_of_all_lengths(spark):
    import random

    from brindle.operators import lexicon as lx

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [texts[0], texts[1].upper(), "", None]
    phrases = [t[a : a + n] for t in texts[:60] for n in (1, 5, 7, 8, 9, 15, 16, 31, 32, 33, 70) if len(t) > n for a in [rng.randrange(len(t) - n)]]
    phrases += [p[:-1] + "z" for p in phrases[::3]] + phrases[:5] + ["", None]
    rows = [(k % 400 if k % 7 else None, p) for k, p in enumerate(phrases)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(rows + rows[:3], "pos long, phrase string")
    told = lx.hits_table(docs, table, most=0)
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    expected = [(d, pos, p.lower()) for d, t in enumerate(texts) if t for pos, p in rows + rows[:3] if p and p.lower() in t.lower()]
    assert sorted(map(tuple, told.collect()), key=key) == sorted(expected, key=key)


def test_index_copies_no_phrase_by_its_grams(spark):
    from brindle.operators import lexicon as lx

    table = spark.createDataFrame([(k, f"the same beginning of a phrase and then {k * 7919}") for k in range(50)], "pos long, phrase string")
    index = lx.index_of(table)
    assert index.count() == 50
    assert index.select("gram").distinct().count() > 25  # not all under the grams that they share
    assert {r["size"] for r in index.collect()} == {32}


def test_moderation_bounds_its_batches_of_texts(spark, conf):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert q.QUERIES["moderation_bands"](spark, SF).count() > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def found_plainly(texts, phrases):
    """(text's place, pos, phrase) by a plain search."""
    return [(k, pos, p.lower()) for k, t in enumerate(texts) if t for pos, p in phrases if p and p.lower() in t.lower()]


def made_texts(seed, n):
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ß𝄞") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", "ab" * 300]
    cut = [t[a : a + k] for t in texts if t for k in (1, 2, 3, 7, 8, 9, 17, 40, 200) if len(t) > k for a in [rng.randrange(len(t) - k)]]
    return texts, list(enumerate([*cut, *[c + "x" for c in cut[::4]], *cut[:5], "ab" * 30, ""]))


def test_index_compares_bytes_across_slices_and_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from brindle.operators import lexicon as lx

    monkeypatch.setattr(lx, "PLACES", 16)
    texts, phrases = made_texts(3, 40)
    texts = [t and t.lower() for t in texts]
    phrases = [(k, p.lower()) for k, p in phrases if p]
    rows = pa.RecordBatch.from_pydict({"pos": pa.array([k for k, _ in phrases], pa.int64()), "phrase": [p for _, p in phrases]})
    index = lx.Index([pa.Table.from_batches(lx._rarest_grams(np.zeros(lx.BUCKETS, np.int64), iter(part))) for part in ([rows[:100]], [rows[100:]])])
    column = pa.array(["cut off", *texts])[1:]
    told = [(k, h["pos"], h["phrase"]) for k, hits in enumerate(index.hits(column).to_pylist()) for h in hits]
    assert told == found_plainly(texts, phrases) and len(told) > 1000
    counts = index.counts(column).to_pylist()
    for k in range(len(texts)):
        own = [p for t, _, p in told if t == k]
        assert counts[k] == {"n": len(own), "first": min(own, default=None)}


def test_shards_of_a_lexicon_give_its_hits(spark, monkeypatch):
    from brindle.operators import lexicon as lx

    monkeypatch.setattr(lx, "SHARD", 100)
    texts, phrases = made_texts(4, 30)
    texts += texts[:3]
    docs = spark.createDataFrame([(k % 31, t) for k, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(k if k % 9 else None, p) for k, p in phrases], "pos long, phrase string")
    assert len(lx._searches(table, "counts", "struct<n: long, first: string>")) > 3
    expected = [(k % 31, pos if pos % 9 else None, p) for k, pos, p in found_plainly(texts, phrases)]
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    assert sorted(map(tuple, lx.hits_table(docs, table, most=0).collect()), key=key) == sorted(expected, key=key)
    rows = lx.with_hits(docs, table, most=0).collect()
    assert len(rows) == len(texts)
    assert sorted(((r["doc_id"], *h) for r in rows for h in r["found"]), key=key) == sorted(expected, key=key)
    assert all([key((0, *h)) for h in r["found"]] == sorted(key((0, *h)) for h in r["found"]) for r in rows)
    nothing = table.select("pos", F.lit("").alias("phrase"))
    assert lx.hit_counts(docs, nothing).count() == lx.hit_counts(docs, table.limit(0)).count() == lx.hits_table(docs, nothing, most=0).count() == 0
    assert all(r["found"] == [] for r in lx.with_hits(docs, nothing, most=0).collect())
    counts = {r["doc_id"]: (r["n"], r["first"]) for r in lx.hit_counts(docs, table).collect()}
    for k in range(31):
        own = [p for d, _, p in expected if d == k]
        assert counts.get(k) == ((len(own), min(own)) if own else None)


def test_hits_shuffle_neither_texts_nor_hits(spark):
    from brindle.operators import lexicon as lx

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = spark.createDataFrame([(k, f"phrase {k}") for k in range(50)], "pos long, phrase string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(lx.hits_table(docs, table, most=0))
    counted = plan(lx.hit_counts(docs, table))
    assert counted.count("Exchange") == 1 and counted.count("ArrowEvalPython") == 1  # searched once, whatever is filtered
    learned = plan(q.QUERIES["learn_phrases_epoch"](spark, SF))
    assert "LeftSemi" not in learned and learned.count("ArrowEvalPython") == 1


def test_learned_hits_of_texts_that_share_an_id(spark, tmp_path):
    """No text teaches if another of its id hits the lexicon; texts without an id teach nothing and aren't told."""
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    passages = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    odd = [(k, f"{passages[k % 3]}. Taught by number {k}. said again") for k in range(40)] + [(None, "no id here. fine so far"), (5, None), (6, " ")]
    odd += [(k, f"Taught without a hit by {k}. said anew") for k in range(50, 120)]
    docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    phrases = sorted(r["phrase"] for r in q.QUERIES["learn_phrases_epoch"](spark, str(tmp_path)).collect())
    assert phrases == sorted(x[0] for x in con.execute(q.SQL["learn_phrases_epoch"]).fetchall())
    assert any(p.startswith("taught without") for p in phrases) and not any(p.startswith("taught by") for p in phrases)
    told = sorted(map(tuple, q.QUERIES["learned_hits"](spark, str(tmp_path)).select("doc_id", "n", "first").collect()))
    assert told == sorted(con.execute(f"SELECT doc_id, n, first FROM ({q.SQL['learned_hits']})").fetchall())
