import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest tables as (doc_id, text)."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, very long texts, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and then it ran away from the very big dog in the old house by the sea", "en", "a"),
        (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "de", None), (5, long, "en", "b"), (6, long, "en", "b"),
        (7, "one two three", "fr", "c"), (7, "one two three", "fr", "c"), (None, "null id here", "en", "a"),
        (8, "spam " * 50, "en", "a"), (9, "123 456 !!! $$$", "en", "a"), (10, "naïve Ünïcode 文字 ﬁn 😀 test", "de", "b"),
    ]
    kind = "doc_id long, text string, lang string, source string"
    from pyspark.sql import functions as F

    extra = {c: F.lit(1) for c in ("score", "size", "n", "node", "begin", "hits", "n_chars", "row", "target")}
    return spark.createDataFrame(rows, kind).withColumns(extra)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
