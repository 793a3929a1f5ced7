"""Scalar text functions as column expressions.

A null or blank text counts as empty; arrays keep the order in which their members first stand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as content words.
STOP_WORDS = (
    "the", "and", "for", "with", "has", "was", "are", "his", "her", "they",
    "that", "this", "from", "have", "been", "said", "also", "only", "when",
    "into", "after", "their", "there", "were", "what", "which", "about",
    "will", "would", "could", "should", "over", "some", "all", "more",
    "than", "then", "just", "each", "even", "him", "had", "not", "but",
    "out", "who", "two", "time", "very", "our", "here", "where", "both",
    "other", "than", "those", "these", "him", "its", "year", "years",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, however often the body, or lambdas in it, name it."""
    return F.transform(F.array(value), body)[0]


def blank(text: Column) -> Column:
    """True for null, empty and all-white texts."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\s]")


def tokens(text: Column) -> Column:
    """Distinct lower-cased content words: longer than three characters and no stop word."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?\-\"'()]+")
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    return F.filter(F.array_except(F.array_distinct(parts), stop), lambda w: F.length(w) > 3)


def tag_tokens(tag: Column) -> Column:
    """Runs of a-z in the lower-cased tag."""
    return F.regexp_extract_all(F.lower(tag), F.lit("[a-z]+"), F.lit(0))


def csv_list(text: Column) -> Column:
    """Comma-separated entries, trimmed and lower-cased, without blank ones."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    return F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def word_bounded(pattern: str) -> str:
    """One regular expression of a rule's alternatives, each between word boundaries, the boundaries factored out."""
    parts = "|".join(p.strip() for p in pattern.lower().split("|"))
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{parts})(?![\p{{L}}\p{{N}}_])"


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s  - 　]+"), lambda w: w != ""))


def sentences(text: Column) -> Column:
    """Lower-cased sentences, stripped of space, then quotes, then space; blanks dropped."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?\n]+")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bare = F.transform(parts, lambda x: strip(F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")))
    return F.filter(bare, lambda x: x != "")


def first_json(raw: Column) -> Column:
    """The first brace-delimited run up to the first closing brace; null without one. Nested objects are cut short."""
    found = F.regexp_extract(raw, r"(?s)\{.*?\}", 0)
    return F.when(found != "", found)


def strip_fence(raw: Column) -> Column:
    """Text without markdown code fences."""
    return F.trim(F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def hash_tag(tag: Column) -> Column:
    """The tag with a leading ``#``."""
    return F.when(tag.startswith("#"), tag).otherwise(F.concat(F.lit("#"), tag))


def category_title(label: Column) -> Column:
    """Leading ``#`` removed, trimmed, each word capitalised."""
    return F.initcap(F.trim(F.regexp_replace(label, "^#+", "")))


def sentiment_label(raw: Column) -> Column:
    """positive, negative or neutral, by what the model's label contains."""
    low = F.lower(raw)
    return F.when(low.contains("positive"), "positive").when(low.contains("negative"), "negative").otherwise("neutral")


def two_places(x: Column) -> Column:
    """A non-negative number with two decimals, halves rounded up."""
    cents = F.floor(x * 100 + 0.5).cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def https(url: Column) -> Column:
    """http:// becomes https://."""
    return F.regexp_replace(url, "^http://", "https://")


def error_clip(message: Column, width: int = 500) -> Column:
    return F.substring(message, 1, width)
