"""Learning over epochs, lexicons of any length in moderation, per-track maps, and results as they come."""

import datetime as dt

from pyspark.sql import functions as F

from brindle.operators import keywords, lexicon, moderation
from brindle.plans import live as lv
from brindle.plans.results import recording_results, text_result, track_results, with_track_results
from brindle.sources.vocabulary import Rule, Vocabulary

SCORES = "array<struct<label: string, score: double>>"


def judged(rows):
    return moderation.moderate(rows, [], hits="hits")


def test_epochs_equal_judging_all_again(spark):
    bad, fine = [("toxic", 0.97)], [("toxic", 0.1)]
    texts = [
        (1, "we will burn it down. nice day", bad), (2, "they say we will burn it down today", fine), (3, "a nice day for all", fine),
        (4, "known phrase here. also so very bad", bad), (5, "So Very Bad", fine), (6, None, fine), (7, "also so very bad indeed", fine), (8, "x", bad),
    ]
    docs = spark.createDataFrame(texts, f"doc_id long, text string, scores {SCORES}")
    start = spark.createDataFrame([(3, "Known Phrase")], "pos long, phrase string")
    end, verdicts, rows = moderation.learn_epochs(docs, start, judged)
    phrases = {r["phrase"]: r["pos"] for r in end.collect()}
    # text 4 hit the lexicon, so it teaches nothing; text 8 has no sentence of two words
    assert set(phrases) == {"known phrase", "we will burn it down", "nice day"} and phrases["known phrase"] == 3
    again = judged(lexicon.with_hits(docs, end, name="hits").withColumn("hits", F.transform("hits", lambda h: h["phrase"])))
    order = again.columns
    assert sorted(map(repr, verdicts.select(order).collect())) == sorted(map(repr, again.collect()))
    assert rows[0] == 8 and rows[1:] == [3]  # then only texts 1, 2 and 3, which hold a new phrase
    assert moderation.learn_epochs(docs.limit(0), start, judged)[2] == [0]


def test_moderation_takes_found_hits(spark):
    docs = spark.createDataFrame([(1, "abc word", ["abc"]), (2, "blocked word", None), (3, "", [])], "doc_id int, text string, found array<string>")
    got = {r["doc_id"]: r for r in moderation.moderate(docs, ["zz"], ["blocked"], hits="found").collect()}
    assert got[1]["band"] == "lexicon" and got[1]["hits"] == ["abc"] and got[2]["hits"] == ["blocked"] and got[3]["band"] == "blank"
    calls = []

    def scorer(rows):
        calls.append(rows.count())
        return rows.withColumn("scores", F.array(F.struct(F.lit("toxic").alias("label"), F.lit(0.9).alias("score"))))

    scored = {r["doc_id"]: r["band"] for r in moderation.moderate(docs, ["zz"], scorer=scorer, hits="found").collect()}
    assert scored == {1: "lexicon", 2: "high", 3: "blank"} and calls == [1]


def test_track_maps(spark):
    words = Vocabulary(["News"], ["#News", "#Art"], [Rule("news", "#News"), Rule("art", "#Art")])
    rows = [(1, "a", "news art"), (1, "b", "art"), (1, "c", "  "), (2, "a", "news")]
    df = spark.createDataFrame(rows, "rec int, track string, text string")
    df = df.withColumn("result", text_result(F.col("text"), words, keywords.rule_hits(F.col("text"), words.rules)))
    out = with_track_results(recording_results(df, "rec", "track", blocked=["art"]), track_results(df, "rec", "track", blocked=["art"]), "rec", "track")
    got = {r["rec"]: r["per_track"] for r in out.collect()}
    assert got[2] is None and list(got[1]) == ["a", "b"]
    assert got[1]["a"]["tags"] == ["#News"] and got[1]["b"]["tags"] == [] and got[1]["b"]["sentiment"] == "neutral"


def test_live_results_equal_the_batch(spark, tmp_path):
    words = Vocabulary(["Shop"], ["#Look", "#Buy"], [Rule("view|click", "#Look"), Rule("cart", "#Buy")])
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    rows = [
        (1, "transcript_segment", at(1), "view cart"), (1, "transcript_segment", at(0), "click"), (2, "transcript_segment", at(0), "cart"),
        (1, "pipeline_complete", at(5), None), (2, "pipeline_error", at(6), None), (3, "pipeline_complete", at(7), None), (4, "transcript_segment", at(8), "view"),
    ]
    kind = "job_id long, event string, ts timestamp, payload string"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    out = lv.live_results(stream, words, timeout_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    out.option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = lv.batch_results(spark.createDataFrame(rows, kind), words).collect()
    assert got == sorted(map(repr, want))
    by_job = {r["job_id"]: r for r in want}
    assert by_job[1]["result"]["tags"] == ["#Look", "#Buy"] and by_job[2]["result"] is None and by_job[3]["result"]["tags"] == []
