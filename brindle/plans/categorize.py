"""Categorising texts and recordings of several tracks: the drivers over keywords, fusion and scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import hash_tag
from brindle.operators import fusion, keywords
from brindle.sources.vocabulary import Vocabulary


def wanted_tags(custom: Column, auto: Column) -> Column:
    """Custom tags as they are, then the platform's that aren't among them."""
    return F.concat(custom, F.array_except(F.array_distinct(auto), custom))


def known_only(found: Column, known: list[str]) -> Column:
    """Members of ``found`` that the vocabulary has, in their order."""
    listed = F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>")
    return F.filter(found, lambda x: F.array_contains(listed, x))


def with_tags(vocabulary: Vocabulary, new: list[str]) -> Vocabulary:
    """The next version of a vocabulary, with new tags (given a leading #) after its own."""
    tags = list(dict.fromkeys([*vocabulary.tags, *("#" + t.lstrip("#") for t in new)]))
    return Vocabulary(vocabulary.categories, tags, vocabulary.rules)


def tag_texts(
    docs: DataFrame, vocabulary: Vocabulary, blocked: list[str] = (), k: int = 8, third: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """(key, tag, score, rank) of single texts: rules, a third layer (key, tag, score) if there is one, the k best, and
    then without blocked tags."""
    scores = keywords.keyword_scores(docs, vocabulary.rules, key)
    listed = docs.sparkSession.createDataFrame(list(enumerate(vocabulary.tags)), "pos int, tag string")
    listed = listed.groupBy("tag").agg(F.min("pos").alias("pos"))
    layers = [scores]
    found = scores.select(key, "tag")
    if third is not None:
        third = third.select(key, hash_tag(F.col("tag")).alias("tag"), "score")
        found = found.unionByName(third.select(key, "tag"))
        layers = [scores, third.limit(0), third]
    candidates = found.distinct().join(F.broadcast(listed), "tag", "left" if third is not None else "inner")
    candidates = candidates.withColumn("pos", F.coalesce("pos", F.lit(len(vocabulary.tags))))
    scored = fusion.fuse(
        candidates, layers, "tag", lambda a, b, c: fusion.tag_score(a, b, c, third is not None), key
    )
    return fusion.limit_then_block(scored, list(blocked), k, key)


def tag_recordings(
    turns: DataFrame, vocabulary: Vocabulary, recording: str, order: str, blocked: list[str] = (), k: int = 8
) -> DataFrame:
    """(recording, tag, score, place): each track's tags by itself, their first-seen union without blocked tags, k of it."""
    keyed = turns.withColumn("_key", F.struct(recording, order))
    per_track = tag_texts(keyed, vocabulary, (), k, key="_key")
    rows = per_track.select(F.col(f"_key.{recording}"), F.col(f"_key.{order}"), "tag", "score", "rank")
    rows = rows.filter(~fusion.blocked(F.col("tag"), list(blocked)))
    return fusion.merge_tracks(rows, recording, order).filter(F.col("place") <= k)


def assemble(tracks: DataFrame, verdicts: DataFrame, recording: str, track: str) -> DataFrame:
    """(recording, per_track): a map from track to its verdict, of tracks (recording, track) with verdicts (track, ...)."""
    fields = F.struct(*[c for c in verdicts.columns if c != track]).alias("v")
    joined = tracks.select(recording, track).join(verdicts.select(track, fields), track)
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct(track, "v"))))
    return joined.groupBy(recording).agg(listed.alias("per_track"))
