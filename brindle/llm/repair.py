"""Repairs the structure of conversations: a dynamic programme over time-major tensors.

Roles are to read system (or none), then user and assistant in turns. Rows are kept (cost 0), given the other role (1) or
deleted (2; blank and repeated rows must be), empty rows are inserted (5), and a truncated row that stays costs 5 more.
Conversations are bucketed by length; ``backward`` updates the state costs of all conversations of a bucket turn by turn and
stores them, ``trace`` follows the cheapest edits of all of them at once, of equal ones the least in ASCII order.

A conversation longer than ``LONG`` rows never lies in one task: range partitions cut it into chunks, a chunk's costs are a
4 x 4 matrix from the state before it to the state after it, and the matrices' chain gives each chunk its place in the optimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import SPACE
from brindle.staging import bounded_batches, stage

START, SYSTEM, USER, ASSISTANT = range(4)  # states by the last role; as a row's initial, START is any other
MUST, OPEN, PAD = 4, 8, 16  # bits beside the initial: must be deleted, truncated, no row at all
NEXT = np.array([USER, USER, ASSISTANT, USER])  # the role that an inserted or changed row takes
KEEP = np.array([[4, SYSTEM, USER, 4], [4, 4, USER, 4], [4, 4, 4, ASSISTANT], [4, 4, USER, 4]])  # state, initial: state or 4
TAIL = ["", "II", "I", ""]  # rows inserted at the end
END = np.array([0, 10, 5, 0])
NEVER = 1 << 50
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

LONG = 50_000  #: rows from which a conversation is cut into chunks
CHUNK = 4_096  #: rows of a chunk
CHUNK_BYTES = 8 << 20
FLUSH_ROWS, FLUSH_BYTES = 32_768, 64 << 20

DIGEST = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id {}, piece long, place long, edit string, role string, text string"


# ---- the tensors -------------------------------------------------------------------------------------------------------


def backward(codes: np.ndarray, runs: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (turn, state, conversation) from before each turn to the end.

    ``codes`` (turn, conversation) are initials with MUST, OPEN and PAD; ``runs`` says how many rows a deleted one stands for;
    ``end`` (state, conversation) is what follows costs.
    """
    turns, n = codes.shape
    costs = np.empty((turns + 1, 4, n), np.int64)
    costs[turns] = end
    reach = np.full((5, n), NEVER, np.int64)
    each = np.arange(n)
    for t in range(turns - 1, -1, -1):
        after, code = costs[t + 1], codes[t]
        reach[:4] = after
        stays = 5 * ((code & OPEN) > 0) + NEVER * ((code & MUST) > 0)
        best = np.minimum(after + 2 * runs[t], after[NEXT] + 1 + stays)
        best = np.minimum(best, reach[KEEP[:, code & 3], each] + stays)
        best = np.minimum(best, np.minimum(5 + best[NEXT], 10 + best[NEXT[NEXT]]))
        costs[t] = np.where(code & PAD, after, best)
    return costs


def trace(codes: np.ndarray, runs: np.ndarray, costs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edits, turns, states) by (step, conversation), and the last states: cheapest edits, at ties D before I, K and R.

    Edits are ASCII codes, 0 where a conversation has no step; states are those after the edit.
    """
    turns, n = codes.shape
    at, state = np.zeros(n, np.int64), start.astype(np.int64)
    edits, places, states = [], [], []
    while True:
        live = np.flatnonzero(at < turns)
        if not len(live):
            break
        t, s = at[live], state[live]
        code, now = codes[t, live], costs[t, s, live]
        kept = KEEP[s, code & 3]
        pad = (code & PAD) > 0
        delete = ~pad & (costs[t + 1, s, live] + 2 * runs[t, live] == now)
        insert = ~pad & ~delete & (costs[t, NEXT[s], live] + 5 == now)
        late = 5 * ((code & OPEN) > 0)
        stay = (code & MUST) == 0
        keep = ~pad & ~delete & ~insert & stay & (kept < 4) & (costs[t + 1, kept & 3, live] + late == now)
        edit = np.where(pad, 0, np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R")))))
        after = np.where(pad | delete, s, np.where(keep, kept, NEXT[s]))
        row, place, last = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.uint8)
        row[live], place[live], last[live] = edit, t, after
        edits.append(row)
        places.append(place)
        states.append(last)
        state[live] = after
        at[live] = t + ~insert
    shape = (0, n)
    return (
        np.array(edits, np.uint8).reshape(-1, n) if edits else np.zeros(shape, np.uint8),
        np.array(places, np.int64).reshape(-1, n) if places else np.zeros(shape, np.int64),
        np.array(states, np.uint8).reshape(-1, n) if states else np.zeros(shape, np.uint8),
        state,
    )


def _initial(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], START)


def _lines(edits, places, states, roles, texts) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each step; a deleted row has its own role and text."""
    for edit, t, state in zip(edits, places, states, strict=True):
        if edit == 0:
            continue
        letter = chr(edit)
        if letter == "I":
            yield letter, NAMES[int(state)], ""
        else:
            yield letter, NAMES[int(state)] if letter == "R" else roles[t], texts[t]


def _tail(state: int) -> Iterator[tuple[str, str, str]]:
    for letter in TAIL[state]:
        state = int(NEXT[state])
        yield letter, NAMES[state], ""


def _wrapped(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


# ---- conversations that fit a task -------------------------------------------------------------------------------------


class _Talk:
    """One conversation's rows in order, and what is counted on the way."""

    def __init__(self, conv):
        self.conv, self.roles, self.texts, self.codes = conv, [], [], []
        self.blank = self.duplicate = self.truncated = self.distinct = self.illegal = 0
        self.low = self.high = None
        self.seen = set()

    def add(self, turn, role, text, blank, cut) -> int:
        code = before = _initial(role)
        if self.codes and (self.codes[-1] & 3, before) not in LEGAL:
            self.illegal += 1
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        if blank:
            self.blank, code = self.blank + 1, code | MUST
        elif key in self.seen:
            self.duplicate, code = self.duplicate + 1, code | MUST
        elif cut:
            self.truncated, code = self.truncated + 1, code | OPEN
        self.seen.add(key)
        self.roles.append(role)
        self.texts.append("" if code & MUST else text)
        self.codes.append(code)
        return len(self.texts[-1])


def _solved(talks: list[_Talk]) -> Iterator[tuple[_Talk, int, list]]:
    """(conversation, cost, edits): buckets of conversations by length, padded in front to a power of two."""
    buckets: dict[int, list[_Talk]] = {}
    for talk in talks:
        buckets.setdefault(1 << max(len(talk.codes) - 1, 0).bit_length(), []).append(talk)
    for size, held in buckets.items():
        codes = np.full((size, len(held)), PAD, np.uint8)
        for i, talk in enumerate(held):
            codes[size - len(talk.codes) :, i] = talk.codes
        runs = np.ones(codes.shape, np.int64)
        costs = backward(codes, runs, np.repeat(END[:, None], len(held), 1))
        edits, places, states, last = trace(codes, runs, costs, np.zeros(len(held), np.int64))
        for i, talk in enumerate(held):
            places_i = places[:, i] - (size - len(talk.codes))
            lines = [*_lines(edits[:, i], places_i, states[:, i], talk.roles, talk.texts), *_tail(int(last[i]))]
            yield talk, int(costs[0, 0, i]), lines


def _digest(talk: _Talk, cost: int, lines: list) -> list[tuple]:
    gaps = 0 if talk.low is None else _wrapped(talk.high - talk.low + 1 - talk.distinct)
    told = "\n".join(f"{role}:{text}" for edit, role, text in lines if edit != "D")
    audit = "".join(edit for edit, _, _ in lines)
    counts = (gaps, talk.blank, talk.duplicate, talk.truncated, talk.illegal, cost)
    return [(talk.conv, *counts, audit, hashlib.sha256(told.encode()).hexdigest())]


def _turns(talk: _Talk, cost: int, lines: list) -> list[tuple]:
    return [(talk.conv, 0, i, *line) for i, line in enumerate(x for x in lines if x[0] != "D")]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _whole(out, schema: pa.Schema):
    """A partition sorted by conversation and place: tensors of the conversations of some 32,768 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, talk, rows, held = [], None, 0, 0
        for batch in batches:
            for conv, turn, role, text, gone, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if talk is None or talk.conv != conv:
                    if talk is not None:
                        talk.seen = set()
                        done.append(talk)
                    if rows >= FLUSH_ROWS or held >= FLUSH_BYTES:
                        yield _batch([row for x in _solved(done) for row in out(*x)], schema)
                        done, rows, held = [], 0, 0
                    talk = _Talk(conv)
                if not gone:
                    held += talk.add(turn, role, text, blank, cut)
                    rows += 1
        if talk is not None:
            yield _batch([row for x in _solved([*done, talk]) for row in out(*x)], schema)

    return run


# ---- long conversations in chunks --------------------------------------------------------------------------------------

_CHUNK = (
    "conv_id {}, part long, seq long, codes binary, runs array<long>, matrix array<long>, blank long, duplicate long, "
    "truncated long, illegal long, first int, last int, low long, high long, turns long, roles array<string>, texts array<string>"
)


def _chunks(schema: pa.Schema, most: int):
    """A range partition's conversations as chunks with their matrices."""

    def emit(conv, seq, rows):
        from pyspark import TaskContext

        codes, runs, roles, texts = [], [], [], []
        blank = duplicate = truncated = illegal = 0
        before = None
        for _turn, role, text, is_blank, cut, again, copies in rows:
            start = _initial(role)
            illegal += copies - 1 + (before is not None and (before, start) not in LEGAL)
            before = start
            if is_blank:
                blank += copies
                first = 0
            else:
                first = 0 if again else 1
                duplicate += copies - first
                truncated += first and cut
            if first:
                codes.append(start | (OPEN if cut else 0))
                runs.append(1)
                roles.append(role)
                texts.append(text)
            if copies > first:
                codes.append(start | MUST)
                runs.append(copies - first)
                roles.append("")
                texts.append("")
        code, run = np.array(codes, np.uint8)[:, None].repeat(4, 1), np.array(runs, np.int64)[:, None].repeat(4, 1)
        ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
        matrix = np.minimum(backward(code, run, ends)[0], NEVER)  # (state before, state after)
        told = [r[0] for r in rows if r[0] is not None]
        return (
            conv, TaskContext.get().partitionId(), seq, bytes(codes), runs, matrix.ravel().tolist(), blank, duplicate,
            truncated, illegal, _initial(rows[0][1]), before, told[0] if told else None, told[-1] if told else None,
            len(set(told)), roles, texts,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, conv, rows, held = 0, None, [], 0
        for batch in batches:
            for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (now != conv or len(rows) >= most or held >= CHUNK_BYTES):
                    yield _batch([emit(conv, seq, rows)], schema)
                    seq, rows, held = seq + 1, [], 0
                conv = now
                rows.append(tuple(row))
                held += len(row[2])
        if rows:
            yield _batch([emit(conv, seq, rows)], schema)

    return run


_ENDS = "part long, seq long, ends array<long>"
_CHAIN = _ENDS + ", conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _ends(schema: pa.Schema):
    """One conversation's chunks, backwards: what follows each of them costs. Its first row also has the totals."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        now, ends = END.copy(), []
        for row in reversed(rows):
            ends.append(now)
            now = (np.array(row["matrix"]).reshape(4, 4) + now).min(1)
        ends.reverse()
        total = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        for a, b in zip(rows, rows[1:], strict=False):
            total["illegal"] += (a["last"], b["first"]) not in LEGAL
            total["turns"] -= a["high"] is not None and a["high"] == b["low"]
        known = [r for r in rows if r["low"] is not None]
        gaps = _wrapped(known[-1]["high"] - known[0]["low"] + 1 - total["turns"]) if known else 0
        head = (rows[0]["conv_id"], gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], int(now[0]))
        out = [(r["part"], r["seq"], e.tolist(), *(head if not i else (None,) * 7)) for i, (r, e) in enumerate(zip(rows, ends, strict=True))]
        return pa.Table.from_batches([_batch(out, schema)])

    return run


_TRACED = "conv_id {}, part long, seq long, outs array<long>, audits array<string>"


def _traced(schema: pa.Schema):
    """Each chunk's edits and its last state, for each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], np.uint8)[:, None].repeat(4, 1)
                runs = np.array(row["runs"], np.int64)[:, None].repeat(4, 1)
                costs = backward(codes, runs, np.array(row["ends"])[:, None].repeat(4, 1))
                edits, _, _, last = trace(codes, runs, costs, np.arange(4))
                audits = ["".join(map(chr, edits[:, i][edits[:, i] > 0])) for i in range(4)]
                out.append((row["conv_id"], row["part"], row["seq"], last.tolist(), audits))
            yield _batch(out, schema)

    return run


_ENTRY = "part long, seq long, piece long, entry long, tail long"


def _entries(schema: pa.Schema):
    """One conversation's chunks, forwards: the state before each, and after the last."""

    def run(table: pa.Table) -> pa.Table:
        out, state = [], START
        for i, row in enumerate(sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))):
            out.append([row["part"], row["seq"], i, state, None])
            state = row["outs"][state]
        out[-1][4] = state
        return pa.Table.from_batches([_batch([tuple(x) for x in out], schema)])

    return run


def _told(row: dict) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(edit, role, text, rows) of a chunk whose edits are known."""
    state, t = row["entry"], 0
    for letter in row["audit"]:
        if letter == "I":
            state = int(NEXT[state])
            yield letter, NAMES[state], "", 1
            continue
        if letter == "D":
            yield letter, None, None, row["runs"][t]
        elif letter == "K":
            yield letter, row["roles"][t], row["texts"][t], 1
            state = int(KEEP[state, row["codes"][t] & 3])
        else:
            state = int(NEXT[state])
            yield letter, NAMES[state], row["texts"][t], 1
        t += 1
    if row["tail"] is not None:
        yield from ((*line, 1) for line in _tail(row["tail"]))


def _chunk_turns(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stay = [x for x in _told(row) if x[0] != "D"]
                yield _batch([(row["conv_id"], row["piece"], i, *x[:3]) for i, x in enumerate(stay)], schema)

    return run


_PIECE = "conv_id {}, piece long, audit string, told string"


def _pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = list(_told(row))
                told = [f"{role}:{text}" for edit, role, text, _ in lines if edit != "D"]
                audit = "".join(edit * n for edit, _, _, n in lines)
                yield _batch([(row["conv_id"], row["piece"], audit, "\n".join(told) if told else None)], schema)

    return run


def _hashed(schema: pa.Schema):
    """Pieces sorted by conversation and place, read as a stream: only the audit of one conversation is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, begun = None, [], None, False
        for batch in batches:
            for row in batch.to_pylist():
                if digest is None or row["piece"] == 0:
                    if digest is not None:
                        yield _batch([(conv, "".join(audit), digest.hexdigest())], schema)
                    conv, audit, digest, begun = row["conv_id"], [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["told"] is not None:
                    digest.update((("\n" if begun else "") + row["told"]).encode())
                    begun = True
        if digest is not None:
            yield _batch([(conv, "".join(audit), digest.hexdigest())], schema)

    return run


def _long_chunks(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with their edits, totals by conversation) of the rows of long conversations."""
    key = ["conv_id", "turn", "role", "text"]
    alike = stage(rows.filter("not gone").groupBy(*key, "blank", "cut").agg(F.count("*").alias("copies")), "alike")
    turn = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    first = stage(alike.groupBy("conv_id", "role", "text").agg(F.min(turn).alias("first")), "first")
    a, b = alike.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.text") == F.col("b.text"))
    again = ~F.col("a.turn").eqNullSafe(F.col("b.first.turn"))
    marked = a.join(b, same).select(*[f"a.{c}" for c in key], "a.blank", "a.cut", again.alias("again"), "a.copies")
    marked = stage(marked, "marked")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = marked.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    ddl = _CHUNK.format(kind)
    chunks = stage(ranged.mapInArrow(_chunks(_arrow(ddl), CHUNK), ddl), "chunks")
    small = chunks.drop("codes", "runs", "roles", "texts")
    ddl = _CHAIN.format(kind)
    chain = stage(small.groupBy("conv_id").applyInArrow(_ends(_arrow(ddl)), ddl), "chain")
    at = ["part", "seq"]
    ddl = _TRACED.format(kind)
    ended = chunks.select("conv_id", *at, "codes", "runs").join(chain.select(*at, "ends"), at)
    traced = stage(ended.mapInArrow(_traced(_arrow(ddl)), ddl), "traced")
    entries = traced.select("conv_id", *at, "outs").groupBy("conv_id").applyInArrow(_entries(_arrow(_ENTRY)), _ENTRY)
    known = stage(entries.join(traced.drop("conv_id"), at).select(*at, "piece", "entry", "tail", F.expr("audits[entry]").alias("audit")), "known")
    told = chunks.select("conv_id", *at, "codes", "runs", "roles", "texts").join(known, at)
    return told, chain.filter("cost is not null").drop("part", "seq", "ends")


# ---- the operator ------------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32(``conv_id:turn``) modulo 20, nulls read as one space.

    0 drops the row (it stays as ``gone``, so that no conversation is lost), 1 empties its text, 2 removes ``.!?`` from it, 3
    repeats it, 4 makes it the user's. Other columns are left out.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hurt = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_h"))
    cut = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return hurt.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"),
        (F.col("_h") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("_h") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _read(rows: DataFrame) -> DataFrame:
    """Rows with ``gone``, ``blank`` and ``cut`` (no full stop at the end)."""
    ends = F.regexp_replace("text", rf"[{SPACE}]+$", "")
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    return told.select("*", (ends == "").alias("blank"), (~F.substring(ends, F.length(ends), F.lit(1)).isin(".", "!", "?")).alias("cut"))


def _run(rows: DataFrame, turns: bool, long_rows: int) -> DataFrame:
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = (TURNS if turns else DIGEST).format(kind)
    read = _read(rows)
    long_ids = stage(rows.groupBy("conv_id").count().filter(F.col("count") > long_rows).select(F.col("conv_id").alias("_long")), "long_ids")
    some = not long_ids.isEmpty()
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    usual = read.join(long_ids, is_long, "left_anti") if some else read
    dealt = usual.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = dealt.mapInArrow(_whole(_turns if turns else _digest, _arrow(ddl)), ddl)
    if not some:
        return out
    told, totals = _long_chunks(read.join(long_ids, is_long, "left_semi"), kind)
    if turns:
        return out.unionByName(told.mapInArrow(_chunk_turns(_arrow(ddl)), ddl))
    piece, last = _PIECE.format(kind), f"conv_id {kind}, audit string, repaired_sha256 string"
    pieces = told.mapInArrow(_pieces(_arrow(piece)), piece).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    hashed = pieces.mapInArrow(_hashed(_arrow(last)), last).withColumnRenamed("conv_id", "_conv")
    found = totals.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    # A long conversation of which no row is left has no chunk.
    lost = long_ids.join(totals.select("conv_id"), is_long, "left_anti").select(F.col("_long").alias("conv_id"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = lost.select("conv_id", *zero, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return out.unionByName(found).unionByName(nothing)


def audit(rows: DataFrame, long_rows: int = LONG) -> DataFrame:
    """One row for each conv_id (null is one too): gaps in the turns, faults, cheapest edits and a hash of what they leave.

    ``rows`` has conv_id, turn, role, text and, if it comes from ``damage``, gone; null roles and texts read as one space, and
    other columns are left out. Rows are taken by turn (nulls first), then role and text; repeated rows are duplicates. A
    conversation without rows has zeros, an empty audit and the empty text's hash; an empty table gives no rows.
    """
    return _run(rows, False, long_rows)


def repaired(rows: DataFrame, long_rows: int = LONG) -> DataFrame:
    """(conv_id, piece, place, edit, role, text): the repaired conversations, in order of piece and place.

    Nulls, ties and empty tables as in ``audit``; conversations that are deleted whole have no rows.
    """
    return _run(rows, True, long_rows)
