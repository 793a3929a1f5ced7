"""The corpus pipeline, stage by stage."""

from .conftest import SF


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.filter("n_chars <> length(text)").count() == 0
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 100
