"""Moderation: lexicon hits, score bands, intent and severity lattices, roll-up over tracks, lexicon learning.

Model scores and a language model's verdict come as columns; a missing score is 0, a missing verdict leaves the band's
own policy. A blank text is safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import blank, let, sentences, two_places, word_count
from brindle.operators.lexicon import lexicon_hits, with_hits
from brindle.sources.vocabulary import add_phrases
from brindle.staging import bounded_batches, stage

# The labels of the toxicity scores and what a report calls them, and the intents' wording.
TOXIC_LABELS = {
    "toxic": "General toxicity",
    "severe_toxic": "Severe toxicity",
    "obscene": "Obscene language",
    "threat": "Threats of violence",
    "insult": "Personal attacks or insults",
    "identity_hate": "Identity-based hate speech",
}
INTENT_LABELS = (
    "safe, harmless content",
    "direct personal threat or call to violence",
    "hate speech or discrimination against a group",
    "explicit sexual content",
)
FLAG_LABELS = ("severe_toxic", "threat", "identity_hate")
SEVERITIES = ("none", "low", "medium", "high", "critical")
LEXICON_CATEGORY = "Threats / Violence"


def max_score(scores: Column) -> Column:
    """Greatest of an array<struct<label, score>>; 0 for none."""
    return F.coalesce(F.array_max(F.transform(scores, lambda s: s["score"])), F.lit(0.0))


def score_flag(scores: Column) -> Column:
    """True if a label that flags by itself is at 0.5 or more."""
    return F.exists(scores, lambda s: s["label"].isin(*FLAG_LABELS) & (s["score"] >= 0.5))


def flagged_categories(scores: Column, known: bool = True) -> Column:
    """Report names of labels at 0.5 or more, in the scores' order; unknown labels go, or stand for themselves."""
    names = F.create_map(*[F.lit(x) for kv in TOXIC_LABELS.items() for x in kv])
    high = F.filter(scores, lambda s: (s["score"] >= 0.5) & (s["label"].isin(*TOXIC_LABELS) if known else F.lit(True)))
    return F.transform(high, lambda s: F.coalesce(F.element_at(names, s["label"]), s["label"]))


def severity_by_score(top: Column, flag: Column) -> Column:
    return (
        F.when((top >= 0.95) | (flag & (top >= 0.85)), "critical")
        .when(top >= 0.80, "high")
        .when(top >= 0.60, "medium")
        .otherwise("low")
    )


def severity_lattice(intent: Column, flag: Column, top: Column) -> Column:
    return (
        F.when((intent == "harmful") & flag, "critical")
        .when(intent == "harmful", "high")
        .when(flag & (intent == "questionable"), "high")
        .when(flag & (intent == "safe"), "medium")
        .when(intent == "questionable", "medium")
        .when(top > 0.6, "low")
        .otherwise("none")
    )


def intent_of(harmful: Column, safe: Column) -> Column:
    """harmful from 0.55, questionable from 0.35 unless the safe score is 0.5 or more, else safe."""
    return (
        F.when(harmful >= 0.55, "harmful").when((harmful >= 0.35) & (safe < 0.5), "questionable").otherwise("safe")
    )


def reason_text(intent_reason: Column, categories: Column, hits: Column, severity: Column) -> Column:
    detected = F.when(F.size(categories) > 0, F.concat(F.lit("Detected: "), F.array_join(categories, ", ")))
    words = F.when(F.size(hits) > 0, F.concat(F.lit("Monitored words found: "), F.array_join(hits, ", ")))
    parts = F.concat_ws(". ", detected, words)
    return (
        F.when(F.coalesce(intent_reason, F.lit("")) != "", intent_reason)
        .when(parts != "", parts)
        .when(severity == "none", "Content appears safe")
        .otherwise("Content flagged by automated analysis")
    )


def clamp_verdict(severity: Column, intent: Column, flagged: Column) -> tuple[Column, Column, Column]:
    """A model's own verdict held to known values and made consistent: severity, intent, flagged."""
    s = F.when(severity.isin(*SEVERITIES), severity).otherwise("none")
    i = F.when(intent.isin("harmful", "questionable", "safe"), intent).otherwise("safe")
    f = F.when((i == "harmful") & s.isin("high", "critical"), F.lit(True)).otherwise(F.coalesce(flagged, F.lit(False)))
    return F.when(i == "safe", "none").otherwise(s), i, F.when(i == "safe", F.lit(False)).otherwise(f)


def label_score(scores: Column, label: str) -> Column:
    """The score of a label in an array<struct<label, score>>; 0 if it isn't there."""
    found = F.filter(scores, lambda s: s["label"] == label)
    return F.coalesce(F.get(found, 0)["score"], F.lit(0.0))


def intent_verdict(scores: Column) -> Column:
    """struct<intent, reason, harmful> of the intent labels' scores: the greatest harmful one decides, the first of equal
    ones names it."""
    safe, *harmful = INTENT_LABELS
    ranked = F.array_max(
        F.array(*[F.struct(label_score(scores, x).alias("s"), F.lit(-k), F.lit(x).alias("x")) for k, x in enumerate(harmful)])
    )
    top = ranked["s"]
    intent = intent_of(top, label_score(scores, safe))
    named = F.concat(F.lit("NLI classified as: "), ranked["x"], F.lit(" ("), two_places(top), F.lit(")"))
    perhaps = F.concat(F.lit("Potentially harmful content ("), two_places(top), F.lit(")"))
    reason = F.when(intent == "harmful", named).when(intent == "questionable", perhaps).otherwise("")
    return F.struct(intent.alias("intent"), reason.alias("reason"), top.alias("harmful"))


_SCORES = "array<struct<label: string, score: double>>"
_MODEL = "struct<flagged: boolean, severity: string, intent: string, reason: string, categories: array<string>>"


def moderate(
    docs: DataFrame, phrases: list[str], blocked: list[str] = (), scorer=None, key: str = "doc_id", text: str = "text",
    carry: list[str] = (), hits: str | None = None,
) -> DataFrame:
    """key, flagged, severity, intent, band, reason, categories, hits, learns for each row, and the columns ``carry``, in
    one pass.

    ``docs`` may have ``scores`` and ``intent_scores`` (array<struct<label, score>>) and ``model``, a language model's
    verdict (struct<flagged, severity, intent, reason, categories>, null where it gave none); a costly ``scorer`` that
    adds them only sees texts that aren't blank and hit no phrase. Bands, the first that holds:

    blank: safe. lexicon: critical, with the phrases hit; ``blocked`` words count as phrases. low (greatest score below
    0.30): safe. middle (below 0.80): the model's verdict, held to known values; without one the lattice of intent and
    flag. high: always flagged, the severity by score, intent and reason the model's, or else harmful by its score.

    ``hits`` names a column of phrases (array<string>) that were found already, as ``lexicon.with_hits`` does for lexicons of
    any length.

    ``learns`` marks texts whose sentences a lexicon may learn: in the middle band a model that flags as harmful, or a
    flagged harmful intent of 0.70 or more; in the high band unless a model calls the intent safe. Never lexicon hits.
    """
    bounded_batches(docs.sparkSession)  # a worker holds a batch of texts as Arrow and as strings
    words = [w.strip().lower() for w in blocked if w.strip()]
    found = lexicon_hits(F.col(text), [*phrases, *words])
    if hits is not None:  # what a table's index found comes first
        found = F.concat(F.coalesce(F.col(hits), F.array().cast("array<string>")), found)
    marked = docs.withColumn("hits", found).withColumn("blank", blank(F.col(text)))
    if scorer is not None:
        marked = stage(marked, "marked")  # both branches read it: phrases are searched once
        open_ = ~F.col("blank") & (F.size("hits") == 0)
        marked = marked.filter(~open_).unionByName(scorer(marked.filter(open_)), allowMissingColumns=True)
    for name, kind in (("scores", _SCORES), ("intent_scores", _SCORES), ("model", _MODEL)):
        if name not in marked.columns:
            marked = marked.withColumn(name, F.lit(None).cast(kind))
    none = F.array().cast("array<string>")
    rounded = F.transform("scores", lambda s: F.struct(F.lower(s["label"]).alias("label"), F.round(s["score"], 4).alias("score")))
    rows = marked.select(
        F.col(key), F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"), "hits", "blank", "model", F.coalesce(rounded, F.array().cast(_SCORES)).alias("scores"),
        intent_verdict(F.coalesce("intent_scores", F.array().cast(_SCORES))).alias("nli"),
        F.filter(F.array(*[F.lit(w) for w in blocked]) if blocked else none, lambda w: F.contains(F.lower(text), F.lower(w))).alias("found"),
    )
    rows = rows.withColumns({"top": max_score(F.col("scores")), "flag": score_flag(F.col("scores"))})
    band = (
        F.when(F.col("blank"), "blank")
        .when(F.size("hits") > 0, "lexicon")
        .when(F.col("top") < 0.30, "low")
        .when(F.col("top") < 0.80, "middle")
        .otherwise("high")
    )
    rows = rows.withColumns({"band": band, "own": F.col("model").isNotNull()})
    middle, high, own = F.col("band") == "middle", F.col("band") == "high", F.col("own")
    says, means, flags = clamp_verdict(F.col("model.severity"), F.col("model.intent"), F.col("model.flagged"))
    by_lattice = severity_lattice(F.col("nli.intent"), F.col("flag"), F.col("top"))
    severity = (
        F.when(F.col("band").isin("blank", "low"), "none")
        .when(F.col("band") == "lexicon", "critical")
        .when(high, severity_by_score(F.col("top"), F.col("flag")))
        .otherwise(F.when(own, says).otherwise(by_lattice))
    )
    intent = (
        F.when(F.col("band").isin("blank", "low"), "safe")
        .when(F.col("band") == "lexicon", "harmful")
        .otherwise(F.when(own, means).when(high, "harmful").otherwise(F.col("nli.intent")))
    )
    rows = rows.withColumns({"severity": severity, "intent": intent})
    serious = F.col("severity").isin("high", "critical")
    listed = F.when(F.col("band").isin("blank", "low"), none).when(F.col("band") == "lexicon", F.array(F.lit(LEXICON_CATEGORY)))
    own_list = F.coalesce("model.categories", none)
    all_names = flagged_categories(F.col("scores"), known=False)
    reason = (
        F.when(F.col("band").isin("blank", "low"), "")
        .when(F.col("band") == "lexicon", F.concat(F.lit("Contains flagged harmful language: "), F.array_join(F.slice("hits", 1, 5), ", ")))
        .when(own, F.coalesce("model.reason", F.lit("")))
        .when(high, F.concat(F.lit("High toxicity detected (score "), two_places(F.col("top")), F.lit(")")))
        .otherwise(reason_text(F.col("nli.reason"), all_names, F.col("found"), F.col("severity")))
    )
    flagged = (F.col("band") == "lexicon") | high | (middle & F.when(own, flags).otherwise(serious))
    rows = rows.withColumns(
        {
            "flagged": flagged,
            "reason": reason,
            "categories": listed.when(own, own_list).otherwise(flagged_categories(F.col("scores"))),
            "hits": F.when(F.col("band") == "lexicon", F.col("hits")).when(F.col("blank") | own & (middle | high), none).otherwise(F.col("found")),
        }
    )
    sure = F.when(own, F.lit(True)).otherwise(F.col("nli.harmful") >= 0.70)
    learns = (middle & F.col("flagged") & (F.col("intent") == "harmful") & sure) | (high & (F.col("intent") != "safe"))
    return rows.select(key, "flagged", "severity", "intent", "band", "reason", "categories", "hits", learns.alias("learns"), *[F.col(f"carried.`{c}`") for c in carry])


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def worst_of_tracks(verdicts: DataFrame, recording: str, order: str) -> DataFrame:
    """The verdict of the greatest severity of each recording; ties go to the first by ``order``."""
    rank = F.struct(severity_rank(F.col("severity")).alias("r"), (-F.col(order)).alias("o"))
    others = [c for c in verdicts.columns if c != recording]
    best = F.max_by(F.struct(*others), rank).alias("v")
    return verdicts.groupBy(recording).agg(best).select(recording, "v.*")


def taught(text: Column) -> Column:
    """array<string>: a text's sentences of 2 to 10 words, each once."""
    return F.array_distinct(F.filter(sentences(text), lambda s: word_count(s).between(2, 10)))


def learned_phrases(flagged: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(phrase): sentences of 2 to 10 words of the texts that may be learned from (``learns`` of ``moderate``) and that
    the lexicon (phrase) lacks. One epoch's additions."""
    return unknown_phrases(flagged.select(taught(F.col(text)).alias("taught")), lexicon)


def unknown_phrases(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(phrase): those of the lists ``taught`` that the lexicon (phrase) lacks, each once."""
    found = rows.select(F.explode("taught").alias("phrase")).distinct()
    return found.join(lexicon.select("phrase"), "phrase", "left_anti")


def learn_epochs(
    docs: DataFrame, lexicon: DataFrame, judge: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", most: int = 20
) -> tuple[DataFrame, DataFrame, list[int]]:
    """(lexicon, verdicts, rows judged in each epoch) once no text teaches a phrase any more.

    ``docs`` has a unique ``key`` and the columns that ``judge`` reads; it gets them with ``hits`` (array<string>), the phrases
    of the lexicon so far (pos, phrase), and gives ``moderate``'s rows. In an epoch the lexicon is fixed. After one, only the
    texts that hold a phrase learned in it are judged again: no other verdict can have changed.
    """
    named = lambda rows, lex: with_hits(rows, lex, text, "hits").withColumn("hits", F.transform("hits", lambda h: h["phrase"]))
    lexicon = stage(lexicon.select("pos", F.lower("phrase").alias("phrase")), "lexicon")
    verdicts = stage(judge(named(docs, lexicon)), "verdicts")
    judged, again = [docs.count()], verdicts
    while len(judged) <= most:
        teachers = docs.join(again.filter("learns").select(key), key, "left_semi")
        fresh = learned_phrases(teachers, lexicon, text).orderBy("phrase")
        fresh = stage(fresh.select(F.monotonically_increasing_id().alias("pos"), "phrase"), "learned")
        if fresh.isEmpty():
            return lexicon, verdicts, judged
        lexicon = stage(add_phrases(lexicon, fresh), "lexicon")
        touched = stage(with_hits(docs, fresh, text, "hits").filter(F.size("hits") > 0).drop("hits"), "touched")
        again = stage(judge(named(touched, lexicon)), "again")
        verdicts = stage(verdicts.join(again.select(key), key, "left_anti").unionByName(again), "verdicts")
        judged.append(touched.count())
    raise RuntimeError(f"texts still teach phrases after {most} epochs")


def blocked_hits(text: Column, words: list[str]) -> Column:
    """array<string>: the words, as they are written, that stand somewhere in the text, case aside. A null text has none."""
    listed = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda t: F.filter(listed, lambda w: F.contains(t, F.lower(w))))
