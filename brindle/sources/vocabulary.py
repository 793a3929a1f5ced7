"""Vocabularies, lexicons and settings: small ordered tables that operators take as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.versions import VersionedTable

#: Phrases that a lexicon may have where it becomes part of a plan; longer ones are refused.
MAX_PHRASES = 20_000


@dataclass(frozen=True)
class Rule:
    """Alternatives, separated by ``|``, that score a tag."""

    pattern: str
    tag: str


@dataclass
class Vocabulary:
    """Ordered categories, tags and keyword rules. The order breaks ties."""

    categories: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, pos, line) of a text file with ``[SECTION]`` headers; blank lines are dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")))
    text = F.trim("col")
    named = lines.select("pos", text.alias("line")).filter("line <> ''")
    head = F.regexp_extract("line", r"^\[(.+)\]$", 1)
    marked = named.select("pos", "line", F.when(head != "", head).alias("head"))
    # a vocabulary file is one small text: its lines are one window
    from pyspark.sql import Window

    section = F.last("head", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("pos"))
    return marked.select(F.upper(section).alias("section"), "pos", "line", "head").filter("head IS NULL").drop("head")


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """Categories, tags and rules; a rule is split at its last ``=``."""
    found = Vocabulary()
    for r in read_sections(spark, path).orderBy("pos").collect():
        if r["section"] == "CATEGORIES":
            found.categories.append(r["line"])
        elif r["section"] == "TAGS":
            found.tags.append(r["line"])
        elif "=" in r["line"]:
            pattern, _, tag = r["line"].rpartition("=")
            found.rules.append(Rule(pattern.strip(), tag.strip()))
    return found


def write_vocabulary(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    """A new version of the vocabulary as a table (section, pos, line)."""
    rows = [("CATEGORIES", i, c) for i, c in enumerate(vocabulary.categories)]
    rows += [("TAGS", i, t) for i, t in enumerate(vocabulary.tags)]
    rows += [("KEYWORDS", i, f"{r.pattern} = {r.tag}") for i, r in enumerate(vocabulary.rules)]
    spark.createDataFrame(rows, "section string, pos int, line string").write.mode("overwrite").parquet(path)


def write_sections(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    """The vocabulary as a text file with sections, which ``read_sections`` reads; blank lines stand between them."""
    rules = [f"{r.pattern} = {r.tag}" for r in vocabulary.rules]
    lines = ["[CATEGORIES]", *vocabulary.categories, "", "[TAGS]", *vocabulary.tags, "[KEYWORDS]", *rules]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def phrases(lexicon: DataFrame) -> list[str]:
    """The lower-cased phrases of (pos, phrase), in order; duplicates stay."""
    rows = lexicon.select("pos", F.lower("phrase").alias("phrase")).orderBy("pos").limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError(f"a lexicon of more than {MAX_PHRASES} phrases; match it as a table")
    return [r["phrase"] for r in rows]


LEXICON_SCHEMA = "phrase string, pos long, origin string, gone boolean"


def lexicon_store(spark: SparkSession, path: str) -> VersionedTable:
    """A stored lexicon: its versions are rows by phrase, and removed phrases are marked as gone."""
    return VersionedTable(spark, path, LEXICON_SCHEMA, "phrase", {"gone": False})


def stored_phrases(store: VersionedTable, version: int | None = None) -> DataFrame:
    """(pos, phrase, origin) of a version's phrases."""
    return store.read(version).filter("NOT gone").select("pos", "phrase", "origin")


def store_phrases(store: VersionedTable, new: DataFrame, origin: str) -> int:
    """The next version with the phrases of ``new`` (pos, phrase) that it lacks, after its last one."""

    def change(now: DataFrame) -> DataFrame:
        live = now.filter("NOT gone").select("pos", "phrase")
        fresh = add_phrases(live, new).join(live.select("phrase"), "phrase", "left_anti")
        return fresh.select("phrase", "pos", F.lit(origin).alias("origin"), F.lit(False).alias("gone"))

    return store.update(change)


def forget_phrases(store: VersionedTable, gone: DataFrame) -> int:
    """The next version without the phrases of ``gone`` (phrase)."""
    named = gone.select(F.lower("phrase").alias("phrase")).distinct()
    return store.update(lambda now: now.filter("NOT gone").join(named, "phrase", "left_semi").withColumn("gone", F.lit(True)))


def union_lexicons(harm: DataFrame, platform: DataFrame) -> DataFrame:
    """Both lexicons (pos, phrase), harm first, duplicates kept, with their origin."""
    n = harm.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    return harm.select("pos", "phrase", F.lit("harm").alias("origin")).unionByName(
        platform.select((F.col("pos") + n).alias("pos"), "phrase", F.lit("platform").alias("origin"))
    )


def add_phrases(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """The next version: lower-cased phrases of ``new`` that the lexicon lacks go after its last, by their pos."""
    n = lexicon.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    fresh = new.select("pos", F.lower(F.trim("phrase")).alias("phrase")).filter("phrase <> ''")
    fresh = fresh.groupBy("phrase").agg(F.min("pos").alias("pos")).join(lexicon.select("phrase"), "phrase", "left_anti")
    return lexicon.select("pos", "phrase").unionByName(fresh.select((F.col("pos") + n).alias("pos"), "phrase"))


def remove_phrases(lexicon: DataFrame, gone: DataFrame) -> DataFrame:
    return lexicon.join(gone.select(F.lower("phrase").alias("phrase")), "phrase", "left_anti").select("pos", "phrase")
