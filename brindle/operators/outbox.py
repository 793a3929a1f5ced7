"""Callbacks as a stored outbox: what was tried how often, and when it is due again.

A batch sends each due callback once and commits the outcomes as the outbox's next version, so no task waits between tries
and a driver that is started anew goes on where the last one stopped. A batch that dies after sending sends again:
receivers tell repeats by the job's id.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import jobs as jb
from brindle.sources.versions import Conflict, VersionedTable
from brindle.staging import stage, unstage

OUTBOX_SCHEMA = "id string, callback_url string, payload string, attempts int, next_due timestamp, state string, code int"


def outbox_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, OUTBOX_SCHEMA)


def _time(now: dt.datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def posted(jobs: DataFrame, outbox: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Outbox rows of finished jobs that it lacks: ``waiting`` and due now, or ``invalid`` where the address is."""
    due = jb.undelivered(jobs).select(F.col("id").cast("string").alias("id"), "callback_url", "action")
    payloads = jb.result_payload(jobs).select(F.col("id").cast("string").alias("id"), "payload")
    new = due.join(payloads, "id").join(outbox.select("id"), "id", "left_anti")
    return new.select(
        "id", "callback_url", "payload", F.lit(0).alias("attempts"), _time(now).alias("next_due"),
        F.when(F.col("action") == "send", "waiting").otherwise("invalid").alias("state"), F.lit(None).cast("int").alias("code"),
    )


def due(outbox: DataFrame, now: dt.datetime | Column) -> DataFrame:
    return outbox.filter((F.col("state") == "waiting") & (F.col("next_due") <= _time(now)))


def attempted(rows: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Outbox rows after a try that answered ``code`` (null: none): delivered, failed for good, or due after a delay."""
    tries = F.col("attempts") + 1
    outcome = F.coalesce(jb.callback_outcome(F.col("code")), F.lit("retry"))
    state = (
        F.when(outcome == "delivered", "delivered")
        .when((outcome == "permanent") | (tries >= jb.CALLBACK_ATTEMPTS), "failed")
        .otherwise("waiting")
    )
    wait = F.make_interval(secs=jb.callback_delay(tries))
    return rows.select(
        "id", "callback_url", "payload", tries.cast("int").alias("attempts"), (_time(now) + wait).alias("next_due"),
        state.alias("state"), F.col("code").cast("int").alias("code"),
    )


def _send(post: Callable[[str, str], int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        codes = []
        for url, payload in zip(rows["callback_url"], rows["payload"], strict=True):
            try:
                codes.append(post(url, payload))
            except Exception:  # whatever fails on the way is tried again
                codes.append(None)
        yield rows.assign(code=pd.array(codes, "Int32"))


def send_due(outbox: VersionedTable, post: Callable[[str, str], int], now: dt.datetime) -> int:
    """Send each callback that is due once, by ``post`` (url, payload -> code), and commit the outcomes. Returns how many."""
    rows = due(outbox.read(), now)
    sent = stage(rows.mapInPandas(lambda b: _send(post, b), rows.schema), "sent")
    n = sent.count()
    while n:
        try:
            outbox.commit(outbox.version(), attempted(sent, now))
            break
        except Conflict:  # others have committed other rows; what was sent stays as it is
            continue
    unstage(sent)
    return n


def delivered_jobs(jobs: DataFrame, outbox: DataFrame) -> DataFrame:
    """The jobs that the outbox has brought to their address, or whose address is invalid, as rows to commit."""
    done = outbox.filter("state IN ('delivered', 'invalid')").select(F.col("id").alias("_done"))
    open_ = jobs.filter(~F.coalesce("callback_delivered", F.lit(False)))
    return open_.join(done, F.col("id").cast("string") == F.col("_done"), "left_semi").withColumn("callback_delivered", F.lit(True))
