"""Conversation repair against a recursive brute force, for conversations in one task and in chunks."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from brindle.llm import repair
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        held.extend([row] * (0 if h == 0 else 2 if h == 3 else 1))
    return out


def brute(conversations):
    found = set()
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for row in rows:
            ends = re.findall(r"[^\x20\x09-\x0D]", row[2])
            faults.append("blank" if not ends else "again" if row[1:] in seen else "cut" if ends[-1] not in ".!?" else "")
            seen.add(row[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

        @lru_cache(None)
        def best(k, state, inserts, rows=rows, faults=faults):
            ways = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
            for name in ("user", "assistant") if inserts < 2 else ():
                if to := STEPS.get((state, name[0])):
                    cost, edits, told = best(k, to, inserts + 1)
                    ways.append((cost + 5, "I" + edits, (f"{name}:", *told)))
            if k < len(rows):
                _, role, text = rows[k]
                cost, edits, told = best(k + 1, state, 0)
                ways.append((cost + 2, "D" + edits, told))
                if faults[k] not in ("blank", "again"):
                    late = 5 * (faults[k] == "cut")
                    for letter, extra, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                        if to := STEPS.get((state, name[:1])):
                            cost, edits, told = best(k + 1, to, 0)
                            ways.append((cost + late + extra, letter + edits, (f"{name}:{text}", *told)))
            return min(ways, default=(10**9, "", ()))

        cost, edits, told = best(0, "", 0)
        digest = hashlib.sha256("\n".join(told).encode()).hexdigest()
        found.add((conv, gaps, faults.count("blank"), faults.count("again"), faults.count("cut"), illegal, cost, edits, digest))
    return found


@pytest.fixture(scope="module")
def odd_rows():
    dice = random.Random(3)
    rows = [(7, i, "user" if i % 3 else "assistant", f"Turn {i}.") for i in range(40)]
    for conv in [None, *range(40), 7]:
        for _ in range(dice.choice([1, 1, 2, 3, 5, 9])):
            turn = dice.choice([None, 0, 1, 2, 3, 4, 5, 6, 9, 9, 12])
            role = dice.choice(["user", "assistant", "system", None, "tool", "", "user", "assistant"])
            text = dice.choice(["Hi.", "Hello", "", "  ", "Yes!", "ok ok?\n", None, "Hi.", f"w{dice.randrange(5)}.", "ü\n:x."])
            rows.append((conv, turn, role, text))
    return rows + [(99, 1, "user", "Same.")] * 20


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_conversation_repair"](spark, SF)) == brute(damaged(rows))


@pytest.mark.parametrize("long_rows", [repair.LONG, 4, 0])
def test_odd_rows_whole_and_in_chunks(spark, odd_rows, long_rows, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 3)
    df = spark.createDataFrame(odd_rows, KIND).selectExpr("*", "1 AS gone", "2 AS blank", "3 AS cut", "4 AS piece", "5 AS part")
    assert rows_of(repair.audit(repair.damage(df), long_rows)) == brute(damaged(odd_rows))


@pytest.mark.parametrize("long_rows", [repair.LONG, 0])
def test_repaired_turns_have_the_hash_of_the_audit(spark, odd_rows, long_rows):
    hurt = repair.damage(spark.createDataFrame(odd_rows, KIND))
    told = {}
    for r in repair.repaired(hurt, long_rows).orderBy("conv_id", "piece", "place").collect():
        told.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.audit(hurt).collect():
        assert hashlib.sha256("\n".join(told.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_undamaged_empty_and_far_turns(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "assistant", "B."), (2, -(2**63), "user", "A."), (2, 2**63 - 1, "assistant", "B.")]
    df = spark.createDataFrame(rows, KIND)
    got = {r["conv_id"]: r for r in repair.audit(df).collect()}
    assert got[1]["audit"] == "KK" and got[1]["cost"] == 0 and got[2]["audit"] == "KK"
    assert repair.audit(df.limit(0)).count() == 0 and repair.repaired(df.limit(0), 0).count() == 0


def test_dropped_conversations_stay(spark):
    gone = [i for i in range(400) if zlib.crc32(f"{i}:1".encode()) % 20 == 0]
    df = spark.createDataFrame([(i, 1, "user", "A.") for i in gone], KIND)
    for long_rows in (repair.LONG, 0):
        got = repair.audit(repair.damage(df), long_rows).collect()
        assert {r["conv_id"] for r in got} == set(gone)
        assert all(r["audit"] == "" and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
