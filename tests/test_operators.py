"""Decision lattices, filters and signal functions on small hand-written rows."""

import itertools
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import dsp
from brindle.functions import signal as sg
from brindle.functions import text as tx
from brindle.operators import frames, fusion, jobs, keywords, moderation, scorers, tracks, transcripts
from brindle.sources import recordings, vocabulary
from brindle.sources.vocabulary import Rule, Vocabulary
from brindle.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_severity_lattice_is_complete(spark):
    grid = list(itertools.product(("harmful", "questionable", "safe"), (True, False), (0.2, 0.6, 0.61, 0.9)))
    df = spark.createDataFrame(grid, "intent string, flag boolean, top double")
    got = {tuple(r[:3]): r[3] for r in df.withColumn("s", moderation.severity_lattice(*map(F.col, df.columns))).collect()}
    for intent, flag, top in grid:
        expected = {
            ("harmful", True): "critical", ("harmful", False): "high", ("questionable", True): "high",
            ("safe", True): "medium", ("questionable", False): "medium",
        }.get((intent, flag), "low" if top > 0.6 else "none")
        assert got[intent, flag, top] == expected


@pytest.mark.parametrize(
    ("top", "flag", "expected"),
    [(0.95, False, "critical"), (0.85, True, "critical"), (0.8499, True, "high"), (0.8, False, "high"), (0.6, False, "medium"), (0.59, True, "low")],
)
def test_severity_by_score(spark, top, flag, expected):
    assert one(spark, moderation.severity_by_score(F.lit(top), F.lit(flag))) == expected


def test_intent_edges(spark):
    rows = [(0.55, 0.9, "harmful"), (0.35, 0.49, "questionable"), (0.35, 0.5, "safe"), (0.34, 0.0, "safe")]
    df = spark.createDataFrame(rows, "h double, s double, e string")
    assert all(r["e"] == r["g"] for r in df.withColumn("g", moderation.intent_of(F.col("h"), F.col("s"))).collect())


def test_moderate_blank_null_and_lexicon(spark):
    scores = "array<struct<label: string, score: double>>"
    bad = moderation.INTENT_LABELS[1]
    rows = [(1, None, [], None), (2, " \n", [], None), (3, "a BOMB here", [], None), (4, "fine", None, [(bad, 0.9)])]
    rows += [(5, "fine", [("threat", 0.5)], [(bad, 0.6)]), (6, "fine", [("odd", 0.55)], []), (7, "fine", [("toxic", 0.87)], [])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, scores {scores}, intent_scores {scores}")
    got = {r["doc_id"]: r for r in moderation.moderate(df, ["bomb"]).collect()}
    assert [got[k]["severity"] for k in range(1, 8)] == ["none", "none", "critical", "none", "critical", "none", "high"]
    assert [got[k]["flagged"] for k in range(1, 8)] == [False, False, True, False, True, False, True]
    assert [got[k]["reason"] for k in range(1, 8)] == [
        "", "", "Contains flagged harmful language: bomb", "", f"NLI classified as: {bad} (0.60)", "Detected: odd",
        "High toxicity detected (score 0.87)",
    ]
    assert [got[k]["learns"] for k in range(1, 8)] == [False] * 6 + [True] and got[7]["intent"] == "harmful"
    hit = {r["doc_id"]: r for r in moderation.moderate(df, [], [" Fine "]).collect()}
    assert hit[4]["band"] == "lexicon" and hit[4]["hits"] == ["fine"]


def test_scorer_sees_only_open_texts(spark):
    seen = []

    def scorer(rows):
        seen.extend(r["doc_id"] for r in rows.collect())
        return rows.withColumn("scores", F.array(F.struct(F.lit("toxic").alias("label"), F.lit(0.9).alias("score"))))

    df = spark.createDataFrame([(1, ""), (2, "bomb"), (3, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["band"] for r in moderation.moderate(df, ["bomb"], scorer=scorer).collect()}
    assert seen == [3] and got == {1: "blank", 2: "lexicon", 3: "high"}


def test_lexicon_ways_agree(spark, monkeypatch):
    from brindle.operators import lexicon

    phrases = ["ab", "B c", "", "ab", "zz", "ÄÖ", "c"]
    rows = [(1, "xAB C"), (2, None), (3, ""), (4, "äöab"), (5, "b c"), (None, "zzz"), (1, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame(list(enumerate(phrases)), "pos int, phrase string")
    expected = sorted([(i, [p.lower() for p in phrases if p and p.lower() in (t or "").lower()]) for i, t in rows], key=repr)
    for inline in (24, 2):
        monkeypatch.setattr(lexicon, "INLINE", inline)
        got = df.select("doc_id", lexicon.lexicon_hits(F.col("text"), phrases).alias("h")).collect()
        assert sorted([(r[0], r[1]) for r in got], key=repr) == expected
    got = [(r[0], r[2]) for r in lexicon.hits_table(df, words).collect()]
    assert sorted(got, key=repr) == sorted([(i, p) for i, ps in expected for p in ps], key=repr)


def test_worst_of_tracks_ties(spark):
    df = spark.createDataFrame([(1, 2, "high"), (1, 1, "high"), (1, 0, "low"), (2, 0, "none")], "r int, t int, severity string")
    assert sorted(tuple(r) for r in moderation.worst_of_tracks(df, "r", "t").collect()) == [(1, 1, "high"), (2, 0, "none")]


def test_learning_is_monotone(spark):
    lexicon = spark.createDataFrame([(0, "bad words")], "pos int, phrase string")
    texts = spark.createDataFrame([('He said "Bad words". New phrase here! one',)], "text string")
    learned = moderation.learned_phrases(texts, lexicon)
    assert sorted(r[0] for r in learned.collect()) == ['he said "bad words', "new phrase here"]
    grown = vocabulary.add_phrases(lexicon, learned.withColumn("pos", F.lit(0)))
    assert grown.count() == 3 and vocabulary.add_phrases(grown, lexicon).count() == 3


def test_keyword_rules(spark):
    df = spark.createDataFrame([(1, "AI again, caféai ai"), (2, None), (3, "")], "doc_id long, text string")
    got = keywords.keyword_scores(df, [Rule("ai | car", "#AI"), Rule("c.fé.i", "#X")])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "#AI", 2, 0.7), (1, "#X", 1, 0.55)]


def test_segment_scores(spark):
    df = spark.createDataFrame([(1, "ai x", ["ai", "no"]), (2, "ai", []), (3, "no", ["ai"])], "doc_id long, text string, segments array<string>")
    got = keywords.segment_scores(df, [Rule("ai", "#AI")])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "#AI", 0.53), (2, "#AI", 0.55), (3, "#AI", 0.4)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["#Aa", "#bA", "#c", "#Dab"]), st.floats(0, 1)), max_size=6), st.integers(1, 4))
def test_blocked_tags_never_return(spark, scored, k):
    rows = [(1, t, i, s) for i, (t, s) in enumerate(dict(scored).items())]
    df = spark.createDataFrame(rows, "doc_id long, tag string, pos int, score double")
    for f in (fusion.limit_then_block, fusion.block_then_limit):
        assert not [r for r in f(df, ["A"], k).collect() if "a" in r["tag"].lower()]
    after, before = fusion.limit_then_block(df, ["A"], k).count(), fusion.block_then_limit(df, ["A"], k).count()
    assert after <= before <= k


def test_top_categories_fallback(spark):
    rows = [(1, "a", 0, 0.1), (1, "b", 1, 0.1), (2, "a", 0, 0.35), (2, "b", 1, 0.9), (2, "c", 2, 0.34)]
    df = spark.createDataFrame(rows, "doc_id long, category string, pos int, score double")
    got = sorted((r["doc_id"], r["category"]) for r in fusion.top_categories(df).collect())
    assert got == [(1, "a"), (2, "a"), (2, "b")]


def test_transcripts(spark):
    word = "struct<word: string, prob: double>"
    kind = f"id int, segments array<struct<id: int, no_speech: double, text: string, words: array<{word}>>>"
    good = [("so", 0.9), ("it", 0.4), ("is", 0.39), ("now", 0.8), (" ", 0.9)]
    rows = [
        (1, [(1, 0.6, " second", [("x", 0.5)]), (0, 0.1, "first ", good)]), (2, [(0, 0.61, "text", good)]),
        (3, [(0, 0.1, "...", good)]), (4, [(0, 0.1, "Thank you!", good)]), (5, []), (6, [(0, 0.1, "a b", good[:2])]), (7, None),
    ]
    df = transcripts.transcripts(spark.createDataFrame(rows, kind))
    got = {r["id"]: (r["text"], r["n_words"], r["silent"]) for r in df.collect() if r["id"] != 7}
    assert got[1] == ("first second", 4, False)
    assert all(got[k][2] and got[k][0] == "" for k in (2, 3, 4, 5, 6))
    loose = transcripts.transcripts(spark.createDataFrame(rows[:2], kind), strict=False)
    assert [r["n_words"] for r in loose.orderBy("id").collect()] == [5, 4]


def test_submit_is_idempotent(spark):
    kind = "id long, recording_id string, job_type string, status string, attempts int, max_tags int, callback_delivered boolean"
    table = spark.createDataFrame([(1, "r", "p", "enhancing", 1, 8, False), (2, "r", "p", "cancelled", 3, 8, True)], kind)
    asked = spark.createDataFrame([(1, "q", "p", 4), (2, "q", "p", 0), (3, "q", "p", None)], "id long, recording_id string, job_type string, max_tags int")
    once = jobs.submit(table, asked)
    assert sorted((r["id"], r["status"], r["attempts"], r["max_tags"]) for r in once.collect()) == [(1, "enhancing", 1, 8), (2, "pending", 0, 0), (3, "pending", 0, 8)]
    assert sorted(once.collect()) == sorted(jobs.submit(once, asked).select(once.columns).collect())


def test_mixing_ignores_track_order(spark):
    rows = [(1, [0.9, 0.5], 1.0), (1, [0.6], 0.5), (1, None, 1.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "r int, samples array<double>, gain double")
        mixed = tracks.mix_tracks(df, "r").first()["samples"]
        assert mixed == pytest.approx([0.99, 0.5 * 0.99 / 1.2])


def test_envelope_matches_numpy(spark):
    x = np.random.RandomState(0).rand(64)
    got = one(spark, sg.envelope_end(F.lit(x.tolist()), 0.9, 0.99))
    assert got == pytest.approx(dsp.Envelope(0.9, 0.99)(x)[-1], abs=1e-12)


def test_signal_edges(spark):
    empty = F.array().cast("array<double>")
    assert one(spark, sg.peak(empty)) == 0.0 and one(spark, sg.rms(empty)) == 0.0
    assert one(spark, sg.peak_normalise(F.lit([0.0, 0.0]))) == [0.0, 0.0]
    assert one(spark, sg.cosine_fade(F.lit(3))) == pytest.approx([0.0, 0.5, 1.0])
    assert one(spark, sg.strip_silence(F.lit([1.0] * 8), F.lit(2), F.lit(7), 2)) == pytest.approx([0, 1, 1, 1, 0])
    assert one(spark, sg.voice(F.lit([170.0] * 5), F.lit(1.0))) == "female_us"
    assert one(spark, sg.voice(F.lit([100.0] * 6 + [200.0] * 6), F.lit(1.0))) == "male_au"
    assert one(spark, sg.suppress(F.lit([1.0, 1.0]), F.lit([0.0, 1.0]))) == pytest.approx([0.08, 1.0])


def filtered(x, *filters):
    for f in filters:
        x = f(x)
    return x


def test_dsp(spark):
    t = np.arange(44_100) / 44_100
    sine = 0.5 * np.sin(2 * math.pi * 997 * t)
    rows = spark.createDataFrame([(1, sine.tolist()), (2, [0.0] * 44_100), (3, (sine * 2).tolist())], "k int, samples array<double>")
    cut = frames.to_frames(rows, ["k"], size=10_000)
    lufs = {r["k"]: r["lufs"] for r in frames.loudness(cut, ["k"]).collect()}
    assert lufs[1] == pytest.approx(20 * math.log10(0.5) - 3.01, abs=0.3) and lufs[2] == -99.0
    level = {r["k"]: r["lufs"] for r in frames.loudness(frames.normalised(cut, ["k"]), ["k"]).collect()}
    assert level[1] == pytest.approx(-16.0, abs=0.1)
    assert {r["k"]: r["peak"] for r in frames.true_peaks(cut, ["k"]).collect()}[1] == pytest.approx(0.5, abs=0.02)
    held = {r["k"]: r["peak"] for r in frames.peaks(frames.limited_true_peak(cut, ["k"]), ["k"]).collect()}
    assert held[3] <= 10 ** (-1 / 20) + 1e-9
    assert len(dsp.resample(sine, 44_100, 16_000)) == 16_000
    gated = filtered(np.concatenate([sine[:4410] * 1e-5, sine[:4410]]), dsp.Gate())
    assert np.abs(gated[2000:4000]).max() < 1e-5 and np.abs(gated[-100:]).max() > 0.4
    assert np.abs(filtered(sine, dsp.Compressor())).max() < 0.5
    assert np.abs(dsp.limit_peak(filtered(np.ones(44_100), dsp.Compressor()))).max() <= 0.99
    low = filtered(0.5 * np.sin(2 * math.pi * 20 * t), *dsp.equaliser())
    assert np.abs(low[4410:]).max() < 0.05
    assert np.median(dsp.pitch_track(np.sin(2 * math.pi * 150 * np.arange(8000) / 16_000), 16_000)) == pytest.approx(150, abs=3)
    out = filtered(np.ones(1000), dsp.Splice(np.zeros(200), 400, 600, 1000, 1000))
    assert len(out) == 1000 - 40 and out[0] == 1 and out[450] == 0


def test_wav_round_trip(spark, tmp_path):
    x = np.linspace(-1, 1, 100)
    (tmp_path / "a.wav").write_bytes(recordings.encode_wav(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    got = {r["path"].rsplit("/", 1)[1]: r for r in recordings.read_waves(spark, str(tmp_path / "*.wav")).collect()}
    assert got["a.wav"]["rate"] == 8000 and np.allclose(got["a.wav"]["samples"], x, atol=1e-4)
    assert got["b.wav"]["samples"] is None


def test_recordings(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": "1", "tracks": [{"id": "b", "sort_order": 2}, {"id": "a", "is_muted": true, "x": 1}]}\nnot json\n')
    got = recordings.tracks_of(recordings.read_recordings(spark, str(tmp_path / "r.json"))).orderBy("place").collect()
    assert [(r["track_id"], r["is_muted"], r["volume"]) for r in got] == [("a", True, 1.0), ("b", False, 1.0)]
    rows = spark.createDataFrame([("A, ,b", None)], "blocked_keywords string, auto_tag_keywords string")
    assert tuple(recordings.settings(rows).first()) == (["a", "b"], [])


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[CATEGORIES]\nNews\n\nNews\n[TAGS]\n#A\n[KEYWORDS]\na=b|c = #A\n")
    got = vocabulary.read_vocabulary(spark, str(tmp_path / "v.txt"))
    assert got == Vocabulary(["News", "News"], ["#A"], [Rule("a=b|c", "#A")])
    vocabulary.write_vocabulary(spark, got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_json_and_labels(spark):
    assert one(spark, tx.first_json(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}'
    assert one(spark, tx.first_json(F.lit("none"))) is None
    assert one(spark, tx.csv_list(F.lit(None).cast("string"))) == []
    assert one(spark, tx.word_count(F.lit(" a b\n c "))) == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "transcript_segment", 1, "a"), (1, "transcript_segment", 2, "b"), (1, "pipeline_complete", 3, ""), (2, "transcript_segment", 1, "c"), (3, "pipeline_error", 5, "")]
    df = spark.createDataFrame(rows, "job_id long, event string, t int, payload string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        ev.fold_stream(stream, None).writeStream.format("memory").queryName("folded").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, ev.fold_batch(df).collect()))


def test_stream_state_is_bounded_and_keys_may_be_text(spark, tmp_path):
    rows = [("a", "transcript_segment", k, str(k)) for k in range(3)] + [("b", "pipeline_complete", 1, "")]
    df = spark.createDataFrame(rows, "job_id string, event string, t int, payload string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        ev.fold_stream(stream, None, 3).writeStream.format("memory").queryName("parts").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("parts").collect())) == [("a", 3, "0 1 2", "partial"), ("b", 0, "", "pipeline_complete")]


def test_silent_jobs_expire(spark, tmp_path):
    df = spark.createDataFrame([("a", "transcript_segment", 1, "x")], "job_id string, event string, t int, payload string")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        ev.fold_stream(stream, 500).writeStream.format("memory").queryName("silent").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    )
    ends = time.monotonic() + 60
    while not spark.table("silent").count() and time.monotonic() < ends:
        time.sleep(0.5)
    query.stop()
    assert list(map(tuple, spark.table("silent").collect())) == [("a", 1, "x", "expired")]


def test_deliver_retries_and_gives_up(spark):
    def post(url, payload):
        if url.endswith("down"):
            raise OSError("no route")
        return {"ok": 204, "gone": 404, "busy": 503}[url.rsplit("/", 1)[1]]

    names = ["ok", "gone", "busy", "down"]
    rows = [(n, f"http://host/{n}", "{}") for n in names] + [("odd", "ftp://host", "{}"), ("none", None, "{}")]
    out = jobs.deliver(spark.createDataFrame(rows, "id string, callback_url string, payload string"), post, 3, lambda s: None)
    assert {r["id"]: tuple(r)[1:] for r in out.collect()} == {
        "ok": (True, 1, 204), "gone": (False, 1, 404), "busy": (False, 3, 503), "down": (False, 3, None),
        "odd": (False, 0, None), "none": (False, 0, None),
    }


def test_stream_callbacks_writes_outcomes(spark, tmp_path):
    df = spark.createDataFrame([("a", "http://host/ok", "{}"), ("b", "http://host/gone", "{}")], "id string, callback_url string, payload string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    due = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    post = lambda url, payload: 200 if url.endswith("ok") else 404
    writer = jobs.stream_callbacks(due, post, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    assert writer.trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).select("id", "delivered", "status")
    assert sorted(map(tuple, out.collect())) == [("a", True, 200), ("b", False, 404)]


def test_platform_lexicon_is_replaced_only_by_words(spark):
    old = spark.createDataFrame([(0, "old")], "pos int, phrase string")
    new = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, phrase string")
    assert sorted(map(tuple, recordings.sync_platform(old, new).collect())) == [(0, "a"), (1, "b")]
    assert [tuple(r) for r in recordings.sync_platform(old, new.limit(0)).collect()] == [(0, "old")]


def test_results_of_single_tracks_blanks_and_nulls(spark):
    from brindle.plans.results import recording_results, text_result

    words = Vocabulary(["News", "Art"], ["#News", "#Art"], [Rule("news", "#News")])
    hit = keywords.rule_hits(F.col("text"), words.rules)
    verdict = "struct<tags: array<string>, categories: array<string>, sentiment: string>"
    rows = [(1, 0, "news", None), (2, 0, "news", None), (2, 1, "x", (["#Odd", None], None, None)), (3, 0, " ", None), (4, 0, None, None)]
    df = spark.createDataFrame(rows, f"rec int, place int, text string, model {verdict}")
    df = df.withColumn("result", text_result(F.col("text"), words, hit, model=F.col("model")))
    blank = df.filter("rec > 2").select("result.*").collect()
    assert all(r["tags"] == [] and r["sentiment"] == "neutral" and not r["llm_used"] for r in blank)
    out = {r["rec"]: r for r in recording_results(df, "rec", "place", blocked=["art"]).collect()}
    assert sorted(out) == [1, 2]
    assert out[1]["tags"] == ["#News"] and out[1]["categories"] == ["News"] and len(out[1]["confidences"]) == 4
    assert out[2]["tags"] == ["#News", "#Odd"] and out[2]["new_tags"] == ["#Odd"] and out[2]["llm_used"]
    assert out[2]["confidences"] == {"#News": 0.55, "#Odd": 0.85} and out[2]["settings_applied"]
    assert recording_results(df.limit(0), "rec", "place").count() == 0


def test_batch_scorer_reads_prefix(spark):
    score = scorers.batch_scorer(lambda: lambda texts: [float(len(t or "")) for t in texts], "text", "s", "double", 3)
    df = spark.createDataFrame([("abcdef",), (None,)], "text string")
    assert [r["s"] for r in score(df).collect()] == [3.0, 0.0]


def test_staged_tables_are_dropped(spark):
    from brindle import staging

    df = staging.stage(spark.range(3), "x")
    path = df.inputFiles()[0]
    assert df.count() == 3 and staging.staging_root(spark) in path
    assert staging.drop_staged(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
