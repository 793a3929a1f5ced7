"""Fusion of score layers into tags and categories, with top-k and blocked-word filters.

Layers that come from the text's own row are arrays of (label, score), fused and ranked within the row, without any
shuffle; layers that are tables of their own are joined (``fuse``). A missing score is 0. Ties go to the smaller ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import let

TAG_LEAST, CATEGORY_LEAST, CATEGORIES = 0.50, 0.35, 3


def tag_score(s1: Column, s2: Column, s3: Column, with_third: bool) -> Column:
    """Rule layer alone, or the weighted sum of three layers with a bonus for agreement."""
    if not with_third:
        return F.round(F.least(F.lit(1.0), s1), 4)
    bonus = F.when((s1 > 0) & (s3 > 0), 0.15).when((s2 > 0) & (s3 > 0), 0.10).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), s1 * 0.4 + s2 * 0.2 + s3 * 0.6 + bonus), 4)


def category_score(s1: Column, s2: Column, s3: Column, with_third: bool) -> Column:
    if not with_third:
        return F.round(F.least(F.lit(1.0), s1 * 0.4 + s2 * 0.6), 4)
    bonus = F.when(((s1 > 0) | (s2 > 0)) & (s3 > 0), 0.10).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), s1 * 0.2 + s2 * 0.3 + s3 * 0.7 + bonus), 4)


def fuse(candidates: DataFrame, layers: list[DataFrame], label: str, score, key: str = "doc_id") -> DataFrame:
    """(key, label, pos, score): candidates (key, label, pos) with up to three layers (key, label, score).

    ``score`` takes the three layers' columns; fewer layers leave 0. Layers are joined on (key, label), so no key is
    hotter than the number of labels.
    """
    out = candidates
    names = []
    for k in range(3):
        names.append(f"s{k + 1}")
        if k < len(layers):
            layer = layers[k].select(key, label, F.col("score").alias(names[-1]))
            out = out.join(layer, [key, label], "left")
            out = out.withColumn(names[-1], F.coalesce(names[-1], F.lit(0.0)))
        else:
            out = out.withColumn(names[-1], F.lit(0.0))
    return out.select(key, label, "pos", score(*map(F.col, names)).alias("score"))


def layer_score(layer: Column, label: Column) -> Column:
    """The score of a label in an array of structs (label, score); 0 if it isn't there."""
    return F.coalesce(F.get(F.filter(layer, lambda x: x["label"] == label), 0)["score"], F.lit(0.0))


_SCORED = "array<struct<label: string, pos: int, score: double>>"


def fuse_row(labels: list[str], layers: list[Column], score, first_prefix: str = "") -> Column:
    """array<struct<label, pos, score>> of the labels, with up to three layers: arrays of structs (label, score).

    The third layer may bring labels of its own, if they begin with #; they stand after the known ones. The first
    layer's labels are the known ones after ``first_prefix``.
    """
    if not layers:
        return F.array().cast(_SCORED)
    bound = F.struct(*[layer.alias(f"l{k}") for k, layer in enumerate(layers)])
    return let(bound, lambda b: _fused(labels, [b[f"l{k}"] for k in range(len(layers))], score, first_prefix))


def _fused(labels: list[str], layers: list[Column], score, first_prefix: str) -> Column:
    known = list(dict.fromkeys(labels))
    entry = lambda x, k: F.struct(x.alias("label"), k.cast("int").alias("pos"))
    listed = F.array(*[entry(F.lit(x), F.lit(k)) for k, x in enumerate(known)])
    if not known:
        listed = F.array().cast("array<struct<label: string, pos: int>>")
    if len(layers) > 2:
        names = F.array(*[F.lit(x) for x in known]).cast("array<string>")
        new = F.filter(layers[2], lambda x: x["label"].startswith("#") & ~F.array_contains(names, x["label"]))
        listed = F.concat(listed, F.transform(new, lambda x, i: entry(x["label"], i + len(known))))
    own = lambda k, x: layer_score(layers[k], F.concat(F.lit(first_prefix), x) if k == 0 and first_prefix else x)
    parts = lambda x: [own(k, x) if k < len(layers) else F.lit(0.0) for k in range(3)]
    made = lambda x: F.struct(x["label"].alias("label"), x["pos"].alias("pos"), score(*parts(x["label"])).alias("score"))
    return F.transform(listed, made).cast(_SCORED)


def best_row(scored: Column, k: int, least: float = TAG_LEAST) -> Column:
    """array<struct<label, score, rank>>: the k best of at least ``least``."""
    order = lambda x: F.struct((-x["score"]).alias("s"), x["pos"].alias("p"), x["label"].alias("label"), x["score"].alias("score"))
    ranked = F.slice(F.array_sort(F.transform(F.filter(scored, lambda x: x["score"] >= least), order)), 1, k)
    return F.transform(ranked, lambda x, i: F.struct(x["label"].alias("label"), x["score"].alias("score"), (i + 1).cast("long").alias("rank")))


def best_categories_row(scored: Column) -> Column:
    """array<struct<label, score, rank>>: up to three of at least 0.35, or else the best one."""
    def chosen(s: Column) -> Column:
        found = best_row(s, CATEGORIES, CATEGORY_LEAST)
        return F.when(F.size(found) > 0, found).otherwise(best_row(s, 1, float("-inf")))

    return let(scored, chosen)


def unblocked(scored: Column, words: list[str]) -> Column:
    """The entries whose label has none of the words."""
    return F.filter(scored, lambda x: ~blocked(x["label"], words))


def top_tags(scored: DataFrame, k: int = 8, least: float = TAG_LEAST, key: str = "doc_id") -> DataFrame:
    """(key, tag, score, rank): the k best tags of at least ``least``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos", "tag"))
    return (
        scored.filter(F.col("score") >= least)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select(key, "tag", "score", F.col("rank").cast("long").alias("rank"))
    )


def top_categories(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, category, score, rank): up to three of at least 0.35, or else the best one."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos", "category"))
    ranked = scored.withColumn("rank", rank)
    keep = (F.col("rank") == 1) | ((F.col("score") >= CATEGORY_LEAST) & (F.col("rank") <= CATEGORIES))
    return ranked.filter(keep).select(key, "category", "score", F.col("rank").cast("long").alias("rank"))


def blocked(tag: Column, words: list[str]) -> Column:
    """True if any of the words stands somewhere in the lower-cased tag."""
    listed = F.array(*[F.lit(w.lower()) for w in words]) if words else F.array().cast("array<string>")
    return F.exists(listed, lambda w: F.contains(F.lower(tag), w))


def limit_then_block(scored: DataFrame, words: list[str], k: int = 8, key: str = "doc_id") -> DataFrame:
    """Single text: the k best tags, then without the blocked ones."""
    return top_tags(scored, k, key=key).filter(~blocked(F.col("tag"), words))


def block_then_limit(scored: DataFrame, words: list[str], k: int = 8, key: str = "doc_id") -> DataFrame:
    """Several tracks: tags without the blocked ones, then the k best."""
    return top_tags(scored.filter(~blocked(F.col("tag"), words)), k, key=key)


def new_labels(found: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """Rows of ``found`` whose label the vocabulary ``known`` (label) lacks."""
    return found.join(known.select(label).distinct(), label, "left_anti")


def merge_tracks(tracks: DataFrame, recording: str, order: str, key: str = "doc_id", label: str = "tag") -> DataFrame:
    """(recording, label, score, place): first-seen distinct union over tracks with each label's first score."""
    first = F.min(F.struct(order, "rank", "score")).alias("f")
    merged = tracks.groupBy(recording, label).agg(first)
    place = F.row_number().over(Window.partitionBy(recording).orderBy(f"f.{order}", "f.rank", label))
    return merged.select(recording, label, F.col("f.score").alias("score"), place.cast("long").alias("place"))


def mode_first_seen(rows: DataFrame, recording: str, value: str, order: str) -> DataFrame:
    """(recording, value): the most frequent value; ties go to the one seen first."""
    counts = rows.groupBy(recording, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct(F.col("n"), (-F.col("first")).alias("o"), F.col(value).alias("v")))
    return counts.groupBy(recording).agg(best.alias("b")).select(recording, F.col("b.v").alias(value))
