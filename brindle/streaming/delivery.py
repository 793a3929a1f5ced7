"""Live events for their subscribers: fan-out, bounded buffers, heartbeats and the job state machine, in batch and as streams.

The streams keep their state with ``transformWithStateInPandas``, which needs Spark's RocksDB state store: see
``use_state_store``. Rows of one key are taken in order of ``ts`` within a batch, and batches as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.events import BUFFER, HEARTBEAT_SECONDS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of rows at the same time, a subscriber joins first and leaves last.
KINDS = {"join": 0, "event": 1, "read": 2, "leave": 3}

# A job's states in order; a job may skip states, start anew once it has ended, and end at any time.
STATES = ("pending", "enhancing", "transcribing", "moderating", "categorizing", "completed")
ENDED = ("completed", "failed", "cancelled")


def use_state_store(spark: SparkSession) -> None:
    """Set the session's state store to the one that these streams need, for the streams that it starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch, in order of time and kind; equal ones as they come."""
    frames = list(rows)
    if not frames:
        return pd.DataFrame()
    whole = pd.concat(frames, ignore_index=True)
    rank = whole["kind"].map(KINDS) if "kind" in whole else 0
    return whole.assign(_rank=rank).sort_values(["ts", "_rank"], kind="stable")


# ---- fan-out -----------------------------------------------------------------------------------------------------------


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(job_id, subscriber, ts, event, payload): each event for each subscriber who is there.

    ``events`` is (job_id, ts, event, payload), ``subscriptions`` (job_id, subscriber, joined, gone), where a null ``gone``
    is one who stays. Who joins later sees nothing of what was before. Overlapping subscriptions of one subscriber count once.
    """
    there = (F.col("ts") >= F.col("joined")) & (F.col("gone").isNull() | (F.col("ts") <= F.col("gone")))
    known = events.withColumn("_event", F.monotonically_increasing_id())
    found = known.join(subscriptions, "job_id").filter(there).dropDuplicates(["_event", "subscriber"])
    return found.select("job_id", "subscriber", "ts", "event", "payload")


class _FanOut(StatefulProcessor):
    """Holds a job's subscribers; an event becomes a row for each of them, and is not kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.here = handle.getMapState("subscribers", "subscriber string", "joined timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _ordered(rows).itertuples():
            if r.kind == "join":
                self.here.updateValue((r.subscriber,), (r.ts.to_pydatetime(),))
            elif r.kind == "leave":
                if self.here.containsKey((r.subscriber,)):
                    self.here.removeKey((r.subscriber,))
            elif self.here.exists():
                out += [(key[0], s[0], r.ts, r.event, r.payload) for s in self.here.keys()]
        yield pd.DataFrame(out, columns=["job_id", "subscriber", "ts", "event", "payload"])

    def close(self) -> None:
        pass


def fan_out_stream(rows: DataFrame) -> DataFrame:
    """``fan_out`` of a stream of (job_id, ts, kind, subscriber, event, payload): kinds ``join``, ``leave`` and ``event``."""
    kind = rows.schema["job_id"].dataType.simpleString()
    ddl = f"job_id {kind}, subscriber string, ts timestamp, event string, payload string"
    return rows.groupBy("job_id").transformWithStateInPandas(_FanOut(), ddl, "Append", "None")


# ---- buffers -----------------------------------------------------------------------------------------------------------


class _Buffer(StatefulProcessor):
    """A subscriber's queue: full, it refuses the newest; a read takes the oldest."""

    def __init__(self, size: int, names: list[str]) -> None:
        self.size, self.names = size, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "ts timestamp, event string, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = list(self.queue.get()) if self.queue.exists() else []
        out = []
        for r in _ordered(rows).itertuples():
            if r.kind == "read":
                taken, queue = queue[: int(r.n)], queue[int(r.n) :]
                out += [(*key, "sent", *x) for x in taken]
            elif len(queue) < self.size:
                queue.append((r.ts.to_pydatetime(), r.event, r.payload))
                out.append((*key, "queued", r.ts, r.event, r.payload))
            else:
                out.append((*key, "refused", r.ts, r.event, r.payload))
        if queue:
            self.queue.put(queue)
        elif self.queue.exists():
            self.queue.clear()
        yield pd.DataFrame(out, columns=[*self.names, "outcome", "ts", "event", "payload"])

    def close(self) -> None:
        pass


def buffer_stream(rows: DataFrame, keys: list[str], size: int = BUFFER) -> DataFrame:
    """(keys, outcome, ts, event, payload) of a stream of (keys, ts, kind, event, payload, n): ``event`` rows are ``queued``
    or ``refused``, and ``read`` rows send the ``n`` oldest. Without reads, what is queued is ``events.bounded_buffer``."""
    named = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"{named}, outcome string, ts timestamp, event string, payload string"
    return rows.groupBy(*keys).transformWithStateInPandas(_Buffer(size, keys), ddl, "Append", "None")


# ---- heartbeats --------------------------------------------------------------------------------------------------------


class _Heartbeat(StatefulProcessor):
    """A timer for each job: silent for so long, it beats, and goes on until the next event."""

    def __init__(self, seconds: float, live: bool) -> None:
        self.seconds, self.live = seconds, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, beats long")

    def _timer(self, timerValues) -> None:
        if self.live:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, told = self.last.get() if self.last.exists() else (None, 0)
        before = None if before is None else pd.Timestamp(before)
        out = []
        for r in _ordered(rows).itertuples():
            if before is not None and r.ts > before:
                gap = (r.ts - before).total_seconds()
                beats = int(gap // self.seconds) if gap > self.seconds else 0
                if beats > told:  # what timers have told already isn't told again
                    out.append((key[0], r.ts, gap, beats - told))
            before, told = (r.ts if before is None else max(before, r.ts)), 0
        if before is not None:
            self.last.update((before.to_pydatetime(), told))
        self._timer(timerValues)
        yield pd.DataFrame(out, columns=["job_id", "ts", "gap", "beats"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, told = self.last.get()
        self.last.update((before, told + 1))
        self._timer(timerValues)
        yield pd.DataFrame([(key[0], pd.Timestamp(before), (told + 1) * self.seconds, 1)], columns=["job_id", "ts", "gap", "beats"])

    def close(self) -> None:
        pass


def heartbeat_stream(events: DataFrame, seconds: float = HEARTBEAT_SECONDS, live: bool = True) -> DataFrame:
    """(job_id, ts, gap, beats) of a stream of (job_id, ts): the beats of each silence longer than ``seconds``.

    ``live`` beats while the silence lasts, by processing time, one row a beat with the time of the last event; what is left
    comes with the event that ends it. Without it, rows are ``events.heartbeat_gaps``, and the stream can end.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    ddl = f"job_id {kind}, ts timestamp, gap double, beats long"
    mode = "ProcessingTime" if live else "None"
    return events.groupBy("job_id").transformWithStateInPandas(_Heartbeat(seconds, live), ddl, "Append", mode)


# ---- the job's states --------------------------------------------------------------------------------------------------


def legal_step(before: Column, after: Column) -> Column:
    """True where a job may go from one state to the next: onward, to an end, or from an end to a new start."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])
    at, to = F.element_at(place, before), F.element_at(place, after)
    onward = F.coalesce(to > at, F.lit(False)) & ~before.isin(*ENDED)
    ends = after.isin("failed", "cancelled") & ~before.isin(*ENDED)
    return (
        F.when(before.isNull(), after == "pending")
        .when(after == "pending", before.isin(*ENDED) | before.isin(*STATES[1:-1]))
        .otherwise(F.coalesce(onward | ends, F.lit(False)))
    )


def illegal_steps(statuses: DataFrame, order: list[str]) -> DataFrame:
    """(job_id, order, before, after): the steps of jobs (job_id, status) that the state machine doesn't know."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy(*order))
    rows = statuses.select("job_id", *order, before.alias("before"), F.col("status").alias("after"))
    return rows.filter(~legal_step(F.col("before"), F.col("after")))


class _Steps(StatefulProcessor):
    """Holds a job's last status, and passes each row on with the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in _ordered(rows).itertuples():
            out.append((key[0], r.ts, before, r.status))
            before = r.status
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["job_id", "ts", "before", "after"])

    def close(self) -> None:
        pass


def illegal_steps_stream(statuses: DataFrame) -> DataFrame:
    """``illegal_steps`` of a stream of (job_id, ts, status)."""
    kind = statuses.schema["job_id"].dataType.simpleString()
    ddl = f"job_id {kind}, ts timestamp, before string, after string"
    steps = statuses.groupBy("job_id").transformWithStateInPandas(_Steps(), ddl, "Append", "None")
    return steps.filter(~legal_step(F.col("before"), F.col("after")))
