"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Null sources are a source of their own (sorted last), null texts have size 0, repeated rows are separate documents,
ties in the seeded order are broken by doc_id and size, an empty table gives an empty plan, and columns named like the
operator's own are renamed by the caller with ``carry``. Sources whose size is 0 get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.text import SPACE, word_count
from brindle.staging import stage

#: First hexadecimal digits of the seeded hash: so many buckets split each source.
BUCKET_DIGITS = 3


def _source_key(source: Column) -> Column:
    """Sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Add ``weight``: the weights, repeating, in the order of ``skey``.

    Sources are ranked in range partitions and the ranks shifted by the partitions' counts, so no task sees them all;
    the counts have one row per partition.
    """
    ranged = stage(
        sources.repartitionByRange("skey").withColumn("pid", F.spark_partition_id()),
        "sources",
    )
    counts = ranged.groupBy("pid").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.pid") < F.col("a.pid"), "left")
    shift = before.groupBy("a.pid").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy("skey")) - 1 + F.col("shift")
    table = F.array(*[F.lit(w) for w in weights])
    return (
        ranged.join(F.broadcast(shift), "pid")
        .withColumn("weight", F.get(table, (place % len(weights)).cast("int")))
        .drop("pid", "shift")
    )


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The level L at which a source's target is min(L * weight, max_epochs * size) and the targets use all words.

    Each round shares what the capped sources leave among the others by weight; sources above their cap join the
    capped, until none is above. Only three sums reach the driver.
    """
    cap = F.col("source_size") * max_epochs
    level = 0.0
    capped = F.lit(False)
    while True:
        total, fixed, weight, n = sources.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, 1)), F.lit(0)),
        ).first()
        if not n or not weight:
            return level
        level = float(total - fixed) / float(weight)
        over = F.col("weight") * F.lit(level) > cap
        if not sources.filter(over & ~capped).limit(1).count():
            return level
        capped = over


def plan_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per document: size, source_size, target (of its source), taken (words the mix takes, repeats counted).

    A source's target is met by whole repetitions of all its documents and one fractional one: documents in the order
    of a seeded hash until the rest is used up, the last taken in part. Word sums by (source, hash bucket) give each
    bucket's place in that order, so that a source's order is never sorted in one task. ``carry`` keeps the
    documents' other columns, in a struct ``row``.
    """
    row_hash = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        _source_key(F.col(source)).alias("skey"),
        word_count(F.col(text)).alias("size"),
        row_hash.alias("h"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []),
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    slim = sized.select("doc_id", "skey", "size", "h", "bucket")
    if not carry:
        sized = slim = stage(slim, "sized")
    buckets = stage(slim.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"))
    sources = stage(source_weights(sources, weights), "weights")
    level = water_level(sources, max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = (
        sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))
        .withColumn("whole", whole.cast("long"))
        .withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        buckets.join(targets, "skey")
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .select("skey", "bucket", "before", "source_size", "target", "whole", "extra")
    )
    within = (
        Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.col("extra") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(left, F.col("size")))
    return (
        sized.join(placed, ["skey", "bucket"])
        .withColumn("taken", F.col("whole") * F.col("size") + part)
        .select("doc_id", "size", "source_size", "target", "taken", *(["row"] if carry else []))
    )


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed documents: each row as often as its taken words say, whole; a rest of words as a shortened copy.

    The shortened copy is the first words of the text, joined by single spaces. Documents of which the mix takes
    nothing go; documents without words are kept once. Columns are those of ``docs``.
    """
    plan = plan_mix(docs, text=text, carry=True, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(F.lit(1))
    rest = F.when(F.col("size") > 0, F.col("taken") - whole * F.col("size")).otherwise(F.lit(0))
    keep = F.array_repeat(F.lit(0).cast("long"), whole.cast("int"))
    copies = F.when(rest > 0, F.concat(keep, F.array(rest.cast("long")))).otherwise(keep)
    short = F.array_join(
        F.slice(F.array_remove(F.split(F.col(f"row.`{text}`"), rf"[{SPACE}]+"), ""), 1, F.col("first").cast("int")), " "
    )
    out = plan.select("row", F.explode(copies).alias("first"))
    return out.select(
        *[
            F.when(F.col("first") > 0, short).otherwise(F.col(f"row.`{c}`")).alias(c)
            if c == text
            else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
