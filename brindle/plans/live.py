"""Realtime jobs as they come: folded transcripts that are categorised in the same stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import keywords
from brindle.plans.results import text_result
from brindle.sources.vocabulary import Vocabulary
from brindle.streaming.events import TIMEOUT_MS, fold_batch, fold_stream


def _categorised(folded: DataFrame, vocabulary: Vocabulary, **options) -> DataFrame:
    text = F.col("transcript")
    result = text_result(text, vocabulary, keywords.rule_hits(text, vocabulary.rules), **options)
    done = F.col("outcome") == "pipeline_complete"
    return folded.withColumn("result", F.when(done, result))


def live_results(events: DataFrame, vocabulary: Vocabulary, timeout_ms: int | None = TIMEOUT_MS, **options) -> DataFrame:
    """``fold_stream`` with ``result``: the final event that completes a job categorises its transcript in the same stream.

    Jobs that end in an error, expire or are passed on in part have a null result. ``options`` go to ``text_result``;
    realtime jobs are not moderated.
    """
    return _categorised(fold_stream(events, timeout_ms), vocabulary, **options)


def batch_results(events: DataFrame, vocabulary: Vocabulary, **options) -> DataFrame:
    """The batch counterpart of ``live_results``."""
    return _categorised(fold_batch(events), vocabulary, **options)
