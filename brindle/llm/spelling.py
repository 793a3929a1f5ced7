"""Groups spelling variants of a corpus's words: an even-partition pigeonhole join for one edit.

A word of length l is indexed by its two even segments; one edit leaves one of them whole. Words of equal length share it in
place, words of one more code point share the first segment in place or the second shifted by one. What is left of the word
holds the edit and is cut evenly once more by the same rule, so that a key is a whole segment and half of the rest: buckets
of frequent prefixes stay small, and no pair is lost. Candidates that two keys give (the edit at a seam) are kept at the first
of them, and every candidate is verified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.staging import stage, unstage

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, delete_every: int | None = 31) -> DataFrame:
    """(word, n): lower-cased (A-Z only) letter runs of at least ``least_length`` code points with their occurrences.

    With ``delete_every``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses one code point first, at that crc32
    modulo its length. Texts are read whole; null texts have no words, a null doc_id counts as the text ``null``, repeated
    rows count as often as they stand. Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    long = F.filter(runs, lambda w: F.length(w) >= least_length)
    found = docs.select(key.alias("_key"), F.explode(long).alias("word"))
    if delete_every:
        h = F.crc32(F.concat_ws(":", "_key", "word"))
        at = (F.col("_h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        hit = F.col("_h") % delete_every == 0
        found = found.withColumn("_h", h).select(F.when(hit, cut).otherwise(F.col("word")).alias("word"))
        found = found.filter(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _part(word: Column, start: Column, size: Column) -> Column:
    """``size`` code points of a word from ``start`` (from 0)."""
    return F.substring(word, start + 1, size)


def _keys(word: Column, size: Column, shift: int) -> Column:
    """The four (size, code, text) keys of a word for indexed words of ``size`` code points; it has ``shift`` more.

    Code 0 and 1: the first segment and the first or second half of the rest; 2 and 3: the second segment and a half.
    """
    one = F.floor(size / 2).cast("int")  # the first segment
    two = size - one
    two_a, one_a = F.floor(two / 2).cast("int"), F.floor(one / 2).cast("int")
    first, second = _part(word, F.lit(0), one), _part(word, one + shift, two)
    halves = [
        F.concat(first, _part(word, one, two_a)),
        F.concat(first, _part(word, one + two_a + shift, two - two_a)),
        F.concat(second, _part(word, F.lit(0), one_a)),
        F.concat(second, _part(word, one_a + shift, one - one_a)),
    ]
    return F.array(*[F.struct(size.alias("size"), F.lit(c).alias("code"), half.alias("part")) for c, half in enumerate(halves)])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, m): pairs of words one inserted, deleted or replaced code point apart, each once.

    ``words`` holds distinct (word, n). Words of one code point are near by replacement, and to the empty word.
    """
    size = F.length("word")
    carried = ["word", "n"]
    index = stage(words.select(*carried, F.inline(_keys(F.col("word"), size, 0))), "spelling_index")
    longer = words.filter(size > 0).select(*carried, F.inline(_keys(F.col("word"), size - 1, 1)))
    probes = index.withColumn("shift", F.lit(0)).unionByName(longer.withColumn("shift", F.lit(1)))
    held = index.select("size", "code", "part", F.col("word").alias("other"), F.col("n").alias("m"))
    found = probes.join(held, ["size", "code", "part"]).filter("shift = 1 or word < other")
    one = F.floor(F.col("size") / 2).cast("int")
    same_first = F.substring("word", F.lit(1), one) == F.substring("other", F.lit(1), one)
    # Within the rest, its first half in place; the rest of codes 2 and 3 is the first segment.
    begin = F.when(F.col("code") < 2, one).otherwise(F.lit(0))
    half = F.floor(F.when(F.col("code") < 2, F.col("size") - one).otherwise(one) / 2).cast("int")
    same_half = _part(F.col("word"), begin, half) == _part(F.col("other"), begin, half)
    seen = ((F.col("code") >= 2) & same_first) | (F.col("code").isin(1, 3) & same_half)
    near = F.levenshtein("word", "other", 1) == 1
    return found.filter(~seen & near).select("word", "n", "other", "m")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct (word, n) with positive counts.

    A word's form is its near word of largest n, ties the least in code-point order, if that n is at least ``ratio`` times
    its own; its root is the last word on the way from form to form, itself without one. An empty table gives none.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, else forms can run in circles")
    words = stage(words.select("word", "n"), "words")
    pairs = stage(near_pairs(words), "near_pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    formed = stage(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"),
        ),
        "formed",
    )
    # Counts grow by the ratio from form to form, which bounds the way; each round doubles the steps that are known.
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(max(most, 1), ratio)) + 1
    up = stage(formed.filter("form is not null").select("word", F.col("form").alias("to")), "forms")
    for _ in range(math.ceil(math.log2(steps + 1))):
        onward = up.select(F.col("word").alias("to"), F.col("to").alias("next"))
        last, up = up, stage(up.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to")), "forms")
        unstage(last)
    out = formed.join(up.withColumnRenamed("to", "root"), "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long"), F.col("n_near").cast("long"),
        F.col("form_n").cast("long"),
    )
