"""The batch pipeline: moderate, categorise what isn't flagged, assemble one row per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import fusion


def enrich(verdicts: DataFrame, tags: Column, categories: Column, max_tags: int = 5, key: str = "doc_id") -> DataFrame:
    """key, flagged, severity, tags (best first, by commas) and the best category; both null for flagged texts.

    ``tags`` and ``categories`` are scored labels (array<struct<label, pos, score>>) over the columns of ``verdicts``;
    they are only evaluated for texts that passed moderation. One row stays one row, so nothing is shuffled.
    """
    passed = ~F.col("flagged")
    best = F.transform(fusion.best_row(tags, max_tags), lambda x: x["label"])
    first = F.get(fusion.best_categories_row(categories), 0)["label"]
    return verdicts.select(
        key, "flagged", "severity", F.when(passed, F.array_join(best, ",")).alias("tags"), F.when(passed, first).alias("category")
    )
