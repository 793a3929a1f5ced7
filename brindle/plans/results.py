"""Whole categorisation results: of texts within their row, of recordings over their tracks.

A result is a struct: tags, categories, confidences (a map from label to score), sentiment, new_tags and new_categories
(labels that the vocabulary lacks, for its next version), settings_applied (the platform names words of its own) and
llm_used (a language model's verdict was taken as it is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import blank, category_title, let, sentiment_label
from brindle.operators import fusion
from brindle.sources.vocabulary import Vocabulary

MODEL_CONFIDENCE, OTHER_CONFIDENCE = 0.85, 0.5
_LAYER, _STRINGS, _MAP = "array<struct<label: string, score: double>>", "array<string>", "map<string, double>"


def _strings(found: Column | None) -> Column:
    none = F.array().cast(_STRINGS)
    return none if found is None else F.array_compact(F.coalesce(found, none))


def _layer(found: Column | None) -> Column:
    none = F.array().cast(_LAYER)
    return none if found is None else F.coalesce(found, none)


def _lacking(found: Column, known: list[str]) -> Column:
    """Distinct members of ``found`` that aren't among ``known``, in their order."""
    listed = F.array(*[F.lit(k) for k in dict.fromkeys(known)]).cast(_STRINGS)
    return F.array_except(found, listed)


def _without(labels: Column, words: list[str]) -> Column:
    return F.filter(labels, lambda x: ~fusion.blocked(x, words))


def _labels(scored: Column) -> Column:
    return F.transform(scored, lambda x: x["label"])


def _result(tags, categories, confidences, sentiment, new_tags, new_categories, settings: bool, llm: bool) -> Column:
    return F.struct(
        tags.cast(_STRINGS).alias("tags"), categories.cast(_STRINGS).alias("categories"),
        confidences.cast(_MAP).alias("confidences"), sentiment.alias("sentiment"),
        new_tags.cast(_STRINGS).alias("new_tags"), new_categories.cast(_STRINGS).alias("new_categories"),
        F.lit(settings).alias("settings_applied"), F.lit(llm).alias("llm_used"),
    )


def text_result(
    text: Column, vocabulary: Vocabulary, hits: Column, second: Column | None = None, third: Column | None = None,
    suggested: Column | None = None, sentiment: Column | None = None, model: Column | None = None,
    blocked: list[str] = (), auto: list[str] = (), k: int | Column = 8,
) -> Column:
    """The result of one text, without any shuffle.

    ``hits`` is the rule layer (``keywords.rule_hits``), ``second`` scores categories, ``third`` tags (with #) and
    categories: arrays of (label, score). An empty third layer counts as none. ``suggested`` holds category names of
    the third layer's model, ``sentiment`` the raw label of a sentiment model. ``model`` is a language model's verdict,
    a struct (tags, categories, sentiment); where it isn't null it is taken as it is, with no confidences. Tags with a
    blocked word go after the ``k`` best are chosen. ``vocabulary`` is the version that has the custom and the
    platform's tags (``categorize.with_tags``). A null or blank text has an empty, neutral result.
    """
    words, settings = [w.lower() for w in blocked], bool(blocked or auto)
    none, empty = F.array(), F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast("array<double>"))
    neutral = F.lit("neutral")
    felt = neutral if sentiment is None else F.coalesce(sentiment_label(sentiment), neutral)

    def scored(b: Column) -> Column:
        asked = F.size(b["third"]) > 0
        either = lambda score: lambda x, y, z: F.when(asked, score(x, y, z, True)).otherwise(score(x, y, z, False))
        topics = F.filter(b["third"], lambda x: ~x["label"].startswith("#"))
        tags = fusion.fuse_row(vocabulary.tags, [b["hits"], _layer(None), b["third"]], either(fusion.tag_score))
        layers = [b["hits"], b["second"], topics]
        categories = fusion.fuse_row(vocabulary.categories, layers, either(fusion.category_score), "#")
        return F.struct(tags.alias("tags"), categories.alias("categories"))

    def merged(b: Column) -> Column:
        tags = _labels(fusion.best_row(b["tags"], k))
        topics = _labels(b["categories"])
        own = F.filter(b["tags"], lambda x: ~F.array_contains(topics, x["label"]))
        pairs = F.transform(F.concat(own, b["categories"]), lambda x: F.struct(x["label"], x["score"]))
        named = F.filter(F.transform(_strings(suggested), category_title), lambda c: c != "")
        return _result(
            _without(tags, words), _labels(fusion.best_categories_row(b["categories"])), F.map_from_entries(pairs), felt,
            _lacking(tags, vocabulary.tags), _lacking(named, vocabulary.categories), settings, False,
        )

    layers = F.struct(hits.alias("hits"), _layer(second).alias("second"), _layer(third).alias("third"))
    out = F.when(blank(text), _result(none, none, empty, neutral, none, none, False, False))
    if model is not None:
        tags = _strings(model["tags"])
        feeling = F.coalesce(model["sentiment"], neutral)
        new = _lacking(tags, vocabulary.tags)
        said = _result(_without(tags, words), _strings(model["categories"]), empty, feeling, new, none, settings, True)
        out = out.when(model.isNotNull(), said)
    return out.otherwise(let(let(layers, scored), merged))


def track_results(
    tracks: DataFrame, recording: str, order: str, text: str = "text", result: str = "result", blocked: list[str] = ()
) -> DataFrame:
    """(recording, order, tags, categories, sentiment): each track's own part in ``recording_results``, without blocked words.

    One row a track that isn't blank, so that a recording of very many tracks is never gathered.
    """
    words = [w.lower() for w in blocked]
    r = F.col(result)
    live = tracks.filter(~blank(F.col(text)))
    return live.select(recording, order, _without(r["tags"], words).alias("tags"), r["categories"].alias("categories"), r["sentiment"].alias("sentiment"))


def with_track_results(results: DataFrame, tracks: DataFrame, recording: str, order: str) -> DataFrame:
    """``recording_results`` with ``per_track``, a map of ``track_results`` by track in their order; null for one track alone."""
    entry = F.struct(F.col(order).alias("key"), F.struct("tags", "categories", "sentiment").alias("value"))
    gathered = tracks.groupBy(recording).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("_map"))
    joined = results.join(gathered, recording, "left")
    return joined.withColumn("per_track", F.when(F.col("n_tracks") > 1, F.col("_map"))).drop("_map")


def recording_results(
    tracks: DataFrame, recording: str, order: str, text: str = "text", result: str = "result",
    blocked: list[str] = (), auto: list[str] = (), k: int = 8,
) -> DataFrame:
    """One result a recording with a track that isn't blank, and ``n_tracks``, of tracks (recording, order, text, result).

    ``result`` is ``text_result`` of each track, without a third layer and without blocked words. Labels go in the order
    in which tracks name them first; tags without blocked words, ``k`` of them. A tag's confidence is its first track's:
    a fixed one where a language model named it. The most frequent sentiment wins, the earlier one of equals. One track
    alone keeps its own result but for the blocked words. Labels are counted by (recording, label) first, so that what
    a recording gathers are its distinct labels, however many tracks it has.
    """
    words, settings = [w.lower() for w in blocked], bool(blocked or auto)
    r = F.col("_r")
    number = "struct<kind: string, rank: int, label: string, score: double>"

    def entries(kind: str, labels: Column, score=lambda x: F.lit(0.0)) -> Column:
        made = lambda x, i: F.struct(F.lit(kind), i, x, score(x)).cast(number)
        return F.transform(labels, made)

    trust = lambda x: F.when(r["llm_used"], MODEL_CONFIDENCE).otherwise(F.coalesce(F.try_element_at(r["confidences"], x), F.lit(OTHER_CONFIDENCE)))
    new = F.when(r["llm_used"], r["new_tags"]).otherwise(F.array().cast(_STRINGS))
    named = F.concat(
        entries("tag", r["tags"], trust), entries("category", r["categories"]), entries("new", new),
        entries("sentiment", F.array(r["sentiment"])),
    )
    live = tracks.filter(~blank(F.col(text)))
    rows = live.select(F.col(recording).alias("_key"), F.col(order).alias("_order"), F.col(result).alias("_r"))
    rows = rows.select("_key", "_order", "_r", F.explode(named).alias("e"))
    whole = F.when(F.col("e.kind") == "sentiment", r)
    rows = rows.select("_key", "_order", "e.*", r["llm_used"].alias("llm"), whole.alias("whole"))
    by_label = rows.groupBy("_key", "kind", "label").agg(
        F.min(F.struct("_order", "rank", "score")).alias("first"), F.count("*").alias("n"),
        F.max("llm").alias("llm"), F.any_value("whole", F.lit(True)).alias("whole"),
    )
    seen = F.array_sort(F.collect_list(F.struct("first", "label", "kind", "n")))
    heard = F.sum(F.when(F.col("kind") == "sentiment", F.col("n")))
    felt = F.min_by("label", F.when(F.col("kind") == "sentiment", F.struct((-F.col("n")).alias("n"), "first"))).alias("felt")
    of = by_label.groupBy("_key").agg(
        seen.alias("seen"), heard.alias("n_tracks"), felt, F.max("llm").alias("llm"),
        F.any_value("whole", F.lit(True)).alias("whole"),
    )
    kind = lambda name: F.filter("seen", lambda x: x["kind"] == name)
    pairs = F.transform(kind("tag"), lambda x: F.struct(x["label"], x["first"]["score"]))
    alone = F.col("n_tracks") == 1
    fields = {
        "tags": (_without(F.col("whole.tags"), words), F.slice(_without(_labels(kind("tag")), words), 1, k)),
        "categories": (F.col("whole.categories"), _labels(kind("category"))),
        "confidences": (F.col("whole.confidences"), F.map_from_entries(pairs)),
        "sentiment": (F.col("whole.sentiment"), F.col("felt")),
        "new_tags": (F.col("whole.new_tags"), _labels(kind("new"))),
        "new_categories": (F.col("whole.new_categories"), F.array().cast(_STRINGS)),
    }
    return of.select(
        F.col("_key").alias(recording), *[F.when(alone, a).otherwise(b).alias(n) for n, (a, b) in fields.items()],
        F.lit(settings).alias("settings_applied"), F.col("llm").alias("llm_used"), "n_tracks",
    )
