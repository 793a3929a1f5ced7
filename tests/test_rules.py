"""Rules in one pass and lexicons by their index, against plain expressions and plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.functions.text import word_bounded
from brindle.operators import keywords, lexicon
from brindle.plans.text_queries import SHARED, many_rules
from brindle.sources.vocabulary import Rule

ODD = [
    Rule("ai|car", "#a"), Rule("breaking news|e-mail", "#b"), Rule("wor.hless|a.b", "#c"), Rule("colou?r|gr[ae]y", "#d"), Rule("x{2}", "#e"),
    Rule("#tag|naïve", "#f"), Rule(" ant | bee ", "#g"), Rule("İst|ß", "#h"), Rule("...", "#i"), Rule("a|a b", "#j"), Rule("car", "#a"), Rule("one two.three", "#k"),
]
TEXTS = [
    "AI again, a car: CARS car", "Breaking  news! breaking news e-mail EMAIL e-mails", "worthless wor hless worXhless axb a b ab", "color colour gray grey greyer",
    "xx xxx x-x", "#tag a#tag naïve NAÏVE naïver", "ant bee antbee", "ist ß strasse", "abc a-b ..", "", None, " \n ", "one two-three one twothree one  two.three",
    "car\ncar.car_car 3car car3",
]


@pytest.mark.parametrize("rules", [ODD, SHARED, many_rules()], ids=["odd", "shared", "many"])
def test_rules_equal_their_expressions(spark, rules):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    docs += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    low = F.lower(F.coalesce("text", F.lit("")))
    counts = df.select("doc_id", *[F.regexp_count(low, F.lit(word_bounded(r.pattern))).alias(f"c{i}") for i, r in enumerate(rules)])
    want = {}
    for row in counts.collect():
        for i, r in enumerate(rules):
            if row[f"c{i}"]:
                want[row["doc_id"], r.tag] = row[f"c{i}"]
    got = {(r["doc_id"], r["tag"]): r["n"] for r in keywords.keyword_scores(df, rules).collect()}
    assert got == want and got
    parts = df.withColumn("segments", F.split("text", "[.\n]", -1))
    seen = parts.select("doc_id", F.explode("segments").alias("s")).select("doc_id", F.lower("s").alias("s"))
    flags = seen.select("doc_id", *[F.col("s").rlike(word_bounded(r.pattern)).cast("int").alias(f"c{i}") for i, r in enumerate(rules)])
    hits, n = {}, {}
    for row in flags.collect():
        n[row["doc_id"]] = n.get(row["doc_id"], 0) + 1
        for i, r in enumerate(rules):
            if row[f"c{i}"]:
                hits[row["doc_id"], r.tag] = hits.get((row["doc_id"], r.tag), 0) + 1
    scores = {(r["doc_id"], r["tag"]): r["score"] for r in keywords.segment_scores(parts, rules).collect()}
    assert set(scores) == set(want) | set(hits)
    for key, score in scores.items():
        whole = min(1.0, want[key] * 0.15 + 0.4) if key in want else 0.0
        assert score == pytest.approx(whole * 0.6 + hits[key] / n[key[0]] * 0.4 if key in hits else whole, abs=1e-4)


def test_two_rules_of_one_tag(spark):
    """The last rule's matches, and the segment hits of both."""
    df = spark.createDataFrame([(1, "a cat and a dog. a cat", ["a cat and a dog", "a cat"])], "doc_id int, text string, segments array<string>")
    got = keywords.segment_scores(df, [Rule("cat", "#pet"), Rule("dog", "#pet")]).collect()
    assert [tuple(r) for r in got] == [(1, "#pet", pytest.approx(0.55 * 0.6 + 3 / 2 * 0.4, abs=1e-4))]


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "a", ["a"])], "doc_id int, text string, segments array<string>")
    assert keywords.keyword_scores(df, []).count() == 0 and keywords.segment_scores(df, []).count() == 0


def hits_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_equals_a_plain_search(spark):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdé ßx") for _ in range(dice.choice([1, 2, 3, 5, 9, 14])))
    texts = [(i, " ".join(word() for _ in range(dice.randrange(40)))) for i in range(150)] + [(200, None), (201, ""), (None, "abc null key"), (1, "abc"), (1, "abc")]
    phrases = [(i, word()) for i in range(400)] + [(900, "abc"), (901, "ABC"), (902, ""), (903, None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    table = spark.createDataFrame(phrases, "pos int, phrase string")
    want = sorted(((k, p, w.lower()) for k, t in texts for p, w in phrases if w and t and w.lower() in t.lower()), key=repr)
    for most in (0, 10_000):  # by the index, by an automaton
        got = sorted((tuple(r) for r in lexicon.hits_table(docs, table, most=most).collect()), key=repr)
        assert got == want and got
        found = lexicon.with_hits(docs, table, name="hits", most=most).select(F.transform("hits", lambda h: h["pos"]).alias("p")).collect()
        assert len(found) == len(texts) and all(r["p"] == sorted(r["p"]) for r in found)
        assert lexicon.hits_table(docs.limit(0), table, most=most).count() == 0
        assert lexicon.hits_table(docs, table.limit(0), most=most).count() == 0


def test_a_lexicon_of_200_000_phrases(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) > 400").limit(40)
    docs = spark.createDataFrame(rows.collect(), rows.schema)
    cut = {f"p{r['doc_id']}": r["text"][100:160] for r in docs.collect() if r["text"]}
    made = spark.range(200_000).select(F.col("id").alias("pos"), F.concat(F.lit("phrase number "), F.col("id")).alias("phrase"))
    real = spark.createDataFrame([(300_000 + i, t) for i, t in enumerate(cut.values())], "pos long, phrase string")
    found = {(r["doc_id"], r["phrase"]) for r in lexicon.hits_table(docs, made.unionByName(real)).collect()}
    want = {(r["doc_id"], t.lower()) for r in docs.collect() for t in cut.values() if t.lower() in r["text"].lower()}
    assert found == want and len(want) >= 40


def test_plans_of_rules():
    assert keywords.plan_of(Rule("ai|car", "t")).simple
    assert keywords.plan_of(Rule("breaking news|news", "t")).pairs == (("breaking", "breaking news"),)
    assert keywords.plan_of(Rule("apache.license|x", "t")).parts == ("license",)
    assert keywords.plan_of(Rule("colou?r", "t")).always and keywords.plan_of(Rule("a|", "t")).always
    assert re.fullmatch(r"\W+", "...") and keywords.plan_of(Rule("...", "t")).always


def test_dotted_words_are_no_literals(spark):
    """An expression runs where both words or their one word stand, not wherever the longer piece does."""
    plan = keywords.plan_of(Rule("the.there|x.y z|other", "t"))
    assert plan.dotted == (("the", "there"),) and plan.loose == ("y z",)
    texts = [("their theretofore", False), ("the other", False), ("there the", True), ("theXthere", True), ("theXthere_", False), ("xy zz", True)]
    own = keywords._read_once(F.col("text"), [plan])
    got = spark.createDataFrame(texts, "text string, needs boolean").select("needs", keywords._needs_expression(plan, own).alias("got"))
    assert all(r["needs"] == r["got"] for r in got.collect())
