"""Job bookkeeping: idempotent submission, recovery, delivery, failure policy, cancellation, results.

The job table is one row per id; every operator returns the next version of it or a report on it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("pending", "enhancing", "transcribing", "moderating", "categorizing")
MAX_ATTEMPTS, CALLBACK_ATTEMPTS, FETCH_ATTEMPTS = 3, 10, 5
PERMANENT_ERRORS = ("ValueError", "TypeError", "AttributeError", "HTTPStatusError")
PERMANENT_STATUS = (400, 401, 403, 404, 422)


def submit(
    jobs: DataFrame, requests: DataFrame, now: Column | None = None, callback_url: str | None = None, changed: bool = False
) -> DataFrame:
    """Jobs after requests (id, recording_id, job_type, max_tags); with ``changed`` only the rows that differ.

    Active jobs stay. Finished ones start anew, with their own recording, address and creation time: their attempts, times,
    result and error are reset and the request's type and ``max_tags`` taken, 0 as it is (``tags_limit`` reads it). Unknown
    ids are new jobs with ``callback_url``, made ``now``. All columns of ``jobs`` are kept; a missing ``max_tags`` is 8. Of
    several requests for one id the first by recording_id counts: the others find it active.
    """
    wanted = requests.groupBy("id").agg(F.min(F.struct("recording_id", "job_type", "max_tags")).alias("r"))
    wanted = wanted.select(F.col("id").alias("rid"), F.col("r.recording_id").alias("r_recording"), F.col("r.job_type").alias("r_type"), F.col("r.max_tags").alias("r_tags"))
    joined = jobs.join(wanted, jobs["id"] == wanted["rid"], "full_outer")
    new = F.col("id").isNull()
    again = F.col("rid").isNotNull() & ~F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False))
    nothing = F.lit(None)
    reset = {
        "status": F.lit("pending"), "attempts": F.lit(0), "started_at": nothing, "completed_at": nothing, "error": nothing,
        "result_json": nothing, "callback_delivered": F.lit(False), "job_type": F.col("r_type"),
        "max_tags": F.coalesce("r_tags", F.lit(8)),
    }
    made = reset | {
        "id": F.col("rid"), "recording_id": F.col("r_recording"), "callback_url": F.lit(callback_url),
        "created_at": F.current_timestamp() if now is None else now, "skip_enhancement": F.lit(False),
        "skip_transcription": F.lit(False),
    }

    def value(c: str) -> Column:
        kind = jobs.schema[c].dataType
        first = made.get(c, nothing).cast(kind)
        return F.when(new, first).when(again, reset[c].cast(kind) if c in reset else F.col(c)).otherwise(F.col(c)).alias(c)

    rows = joined.filter(new | again) if changed else joined
    return rows.select(*[value(c) for c in jobs.columns])


def tags_limit(max_tags: Column) -> Column:
    """How many tags a job takes: 8 where nothing or 0 was asked for."""
    return F.when(F.coalesce(max_tags, F.lit(0)) == 0, F.lit(8)).otherwise(max_tags)


def recover(jobs: DataFrame) -> DataFrame:
    """Active jobs with attempts left go back to pending with one attempt more."""
    back = F.col("status").isin(*ACTIVE) & (F.col("attempts") < MAX_ATTEMPTS)
    return jobs.withColumns(
        {
            "attempts": F.when(back, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "status": F.when(back, "pending").otherwise(F.col("status")),
        }
    )


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def undelivered(jobs: DataFrame) -> DataFrame:
    """Finished jobs whose callback is due, with what to do: send, or mark as delivered where the URL is invalid."""
    due = F.col("status").isin("completed", "failed") & F.col("callback_url").isNotNull() & ~F.col("callback_delivered")
    return jobs.filter(due).withColumn("action", F.when(valid_url(F.col("callback_url")), "send").otherwise("mark"))


def failure_outcome(error_class: Column, http_status: Column, attempts: Column) -> Column:
    """failed for permanent errors and spent attempts, else pending."""
    permanent = error_class.isin(*PERMANENT_ERRORS) | F.coalesce(http_status >= 400, F.lit(False))
    return F.when(permanent | (attempts >= MAX_ATTEMPTS), "failed").otherwise("pending")


def callback_outcome(http_status: Column) -> Column:
    return (
        F.when(http_status < 300, "delivered").when(http_status.isin(*PERMANENT_STATUS), "permanent").otherwise("retry")
    )


def callback_delay(attempts: Column) -> Column:
    """Seconds before the next try of a callback that was tried ``attempts`` times: min(2 * 2^(attempts - 1), 300)."""
    return F.least(F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1))), F.lit(300.0))


def fetch_delay(attempts: Column) -> Column:
    """Seconds before the next try of a fetch that was tried ``attempts`` times: 3 * 2^(attempts - 1); null after the last."""
    return F.when(attempts < FETCH_ATTEMPTS, F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1) * 3)


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Named jobs (id) that aren't finished become cancelled."""
    wanted = ids.select("id", F.lit(True).alias("_c")).distinct()
    stop = F.col("_c").isNotNull() & ~F.col("status").isin(*TERMINAL)
    out = jobs.join(wanted, "id", "left").withColumn("status", F.when(stop, "cancelled").otherwise(F.col("status")))
    return out.drop("_c")


def retry_status(found: Column, status: Column, url: Column, sent: Column) -> Column:
    """HTTP-like code of a manual callback retry."""
    return (
        F.when(~found, 404)
        .when(~status.isin("completed", "failed"), 409)
        .when(~valid_url(url), 400)
        .when(~sent, 502)
        .otherwise(200)
    )


def _job_type() -> Column:
    return F.when(F.coalesce("job_type", F.lit("")) == "", "pipeline").otherwise(F.col("job_type"))


def result_payload(jobs: DataFrame) -> DataFrame:
    """(id, payload): the JSON that a callback sends for finished jobs: job_id, job_type, status, result, error.

    ``result_json`` is JSON text; an empty or missing one is an empty object, a missing error is ``unknown``.
    """
    completed = F.col("status") == "completed"
    result = F.coalesce(F.nullif(F.trim("result_json"), F.lit("")), F.lit("{}"))
    error = F.to_json(F.array(F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("unknown"))))
    head = F.to_json(F.struct(F.col("id").alias("job_id"), _job_type().alias("job_type"), "status"))
    payload = F.concat(
        F.expr("rtrim('}', head)"), F.lit(',"result":'), F.when(completed, result).otherwise("null"), F.lit(',"error":'),
        F.when(completed, "null").otherwise(F.regexp_replace(error, r"^\[|\]$", "")), F.lit("}"),
    )
    rows = jobs.filter(F.col("status").isin("completed", "failed")).withColumn("head", head)
    return rows.select("id", payload.alias("payload"))


def job_view(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """What a caller who asks for jobs (id) sees of each: found, and the job's public columns, times as text."""
    shown = jobs.select(
        F.col("id").alias("_id"), F.lit(True).alias("_found"), _job_type().alias("job_type"), "status", "recording_id",
        "attempts", F.col("result_json").alias("result"), "error", "callback_delivered",
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "started_at", "completed_at")],
    )
    joined = ids.select("id").distinct().join(shown, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_id", "_found")


def latest_status(events: DataFrame, job: str, order: list[str], status: str) -> DataFrame:
    """(job, status): the status of each job's last event."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(*order)).alias(status))


def should_enhance(skip: Column, enhanced: Column, job_type: Column) -> Column:
    return ~skip & ~enhanced & job_type.isin("magic_clean", "pipeline")


def no_speech(text: Column, skipped: Column, existing: Column, n_track_transcripts: Column) -> Column:
    """Transcription was asked for, but there is no text, none that existed before, and none of any track."""
    none = F.coalesce(text, F.lit("")) == ""
    return ~skipped & (F.coalesce(existing, F.lit("")) == "") & none & (n_track_transcripts == 0)


def may_categorize(text: Column, flagged: Column, job_type: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & ~flagged & job_type.isin("tagging", "rebuild", "pipeline")


def key_of(kind: str, *parts: Column) -> Column:
    """Object keys: enhanced/{recording}/{job}-{track}.wav, masters/{recording}/{job}.wav, or
    reconstructed/{recording}/{hash of the parts}.wav."""
    if kind == "enhanced":
        return F.format_string("enhanced/%s/%s-%s.wav", *parts)
    if kind == "masters":
        return F.format_string("masters/%s/%s.wav", *parts)
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)
    return F.concat(F.lit("reconstructed/"), parts[0], F.lit("/"), digest, F.lit(".wav"))


# Content types of downloads besides those that name audio.
BINARY_TYPES = ("application/octet-stream", "binary/octet-stream")


def allowed_download(url: Column, content_type: Column, length: Column) -> Column:
    """A non-empty body at a web address, of an audio or binary type or of none."""
    kind = F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0])
    fits = (kind == "") | kind.contains("audio") | kind.isin(*BINARY_TYPES)
    return valid_url(url) & fits & (F.coalesce(length, F.lit(0)) > 0)


def next_jobs(jobs: DataFrame, slots: int) -> DataFrame:
    """The pending jobs that wait longest, first come first served, ties by id: as many as there are free slots."""
    return jobs.filter("status = 'pending'").orderBy("created_at", "id").limit(slots)


def deliver(
    due: DataFrame, post: Callable[[str, str], int], attempts: int = CALLBACK_ATTEMPTS, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """(id, delivered, attempts, status) of callbacks (id, callback_url, payload) sent by ``post`` (url, payload -> code).

    Codes below 300 deliver, permanent ones end it, others and exceptions are tried again after a growing delay. Invalid
    addresses aren't tried. A lost task sends its rows again: receivers tell repeats by the job's id.
    """

    def one(url: str | None, payload: str) -> tuple[bool, int, int | None]:
        if not url or not url.startswith(("http://", "https://")):
            return False, 0, None
        code = None
        for k in range(attempts):
            try:
                code = post(url, payload)
            except Exception:  # whatever fails on the way is tried again
                code = None
            if code is not None and (code < 300 or code in PERMANENT_STATUS):
                return code < 300, k + 1, code
            wait(min(2.0 * 2.0**k, 300.0))
        return False, attempts, code

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(u, p) for u, p in zip(b["callback_url"], b["payload"])]
            out = pd.DataFrame(found, columns=["delivered", "attempts", "status"])
            yield out.astype({"status": "Int64"}).assign(id=b["id"].to_numpy())

    key = due.schema["id"].dataType.simpleString()
    rows = due.select("id", "callback_url", "payload")
    return rows.mapInPandas(send, f"delivered boolean, attempts int, status long, id {key}").select("id", "delivered", "attempts", "status")


def stream_callbacks(due: DataFrame, post: Callable[[str, str], int], outcomes: str, **options):
    """A stream's callbacks, sent batch by batch; a batch's outcomes are written under ``outcomes``, once for each batch."""

    def send(rows: DataFrame, batch: int) -> None:
        deliver(rows, post, **options).write.mode("overwrite").parquet(f"{outcomes}/batch={batch}")

    return due.writeStream.foreachBatch(send)
