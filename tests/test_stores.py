"""Stored tables: versions, conflicts, the job table and the outbox."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import jobs as jb
from brindle.operators import outbox as ob
from brindle.sources import versions as vs

NOW = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC)


@pytest.fixture
def store(spark, tmp_path):
    return vs.job_table(spark, str(tmp_path / "jobs"))


def asked(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], "id string, recording_id string, job_type string, max_tags int")


def request(spark, *rows):
    return lambda now: jb.submit(now, asked(spark, *rows), F.lit(NOW), "https://x/hook", changed=True)


def rows_of(table):
    return {r["id"]: r.asDict() for r in table.read().collect()}


def test_submit_makes_resets_and_leaves(spark, store):
    assert store.version() == 0 and store.read().count() == 0
    store.update(request(spark, ("a", "r1", "pipeline", 0), ("b", "r2", "tagging", None)))
    got = rows_of(store)
    assert got["a"]["max_tags"] == 0 and got["b"]["max_tags"] == 8 and got["a"]["callback_url"] == "https://x/hook"
    assert got["a"]["created_at"] is not None and got["a"]["skip_enhancement"] is False and got["a"]["attempts"] == 0
    done = {"status": F.lit("completed"), "result_json": F.lit("{}"), "attempts": F.lit(2), "started_at": F.lit(NOW), "callback_delivered": F.lit(True)}
    store.update(lambda now: now.filter("id = 'a'").withColumns(done | {"existing_transcript": F.lit("said")}))
    store.update(request(spark, ("a", "other", "tagging", 3), ("b", "other", "pipeline", 3)))
    got = rows_of(store)
    a = got["a"]
    assert (a["recording_id"], a["job_type"], a["max_tags"], a["status"], a["attempts"]) == ("r1", "tagging", 3, "pending", 0)
    assert a["result_json"] is None and a["started_at"] is None and a["callback_delivered"] is False
    assert a["existing_transcript"] == "said" and a["callback_url"] == "https://x/hook"  # what isn't reset stays
    assert got["b"]["recording_id"] == "r2" and got["b"]["job_type"] == "tagging"  # active: nothing changes
    assert store.version() == 3 and {r["id"] for r in store.changes(1).collect()} == {"a", "b"}
    assert {r["id"]: r["max_tags"] for r in store.read(1).collect()} == {"a": 0, "b": 8}  # versions stay readable


def test_tags_limit(spark):
    df = spark.createDataFrame([(0,), (None,), (3,)], "n int").select(jb.tags_limit(F.col("n")).alias("n"))
    assert [r["n"] for r in df.collect()] == [8, 8, 3]


def test_two_writers(spark, store):
    store.update(request(spark, ("a", "r", "pipeline", 8)))
    base = store.version()
    first, second = (vs.job_table(spark, store.path) for _ in range(2))
    both = request(spark, ("new", "mine", "pipeline", 8))(first.read(base)), request(spark, ("new", "theirs", "pipeline", 8))(second.read(base))
    first.commit(base, both[0])
    with pytest.raises(vs.Conflict):
        second.commit(base, both[1])
    assert rows_of(store)["new"]["recording_id"] == "mine" and len(rows_of(store)) == 2
    folders = [s.getPath().getName() for s in store._fs.listStatus(store._path("rows"))]
    assert len(folders) == 2  # what the loser wrote is gone

    calls = []

    def late(now):  # another writer commits while this one decides
        if not calls:
            first.update(request(spark, ("late", "winner", "pipeline", 8)))
        calls.append(now)
        return request(spark, ("late", "loser", "pipeline", 8))(now)

    second.update(late)
    assert len(calls) == 2 and rows_of(store)["late"]["recording_id"] == "winner"
    calls.clear()
    with pytest.raises(vs.Conflict):
        second.update(lambda now: (first.update(request(spark, (f"x{len(calls)}", "r", "p", 8))), calls.append(1), now)[2], retries=0)


def test_whole_versions_and_migration(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vs, "MERGE_AFTER", 3)
    old = vs.VersionedTable(spark, str(tmp_path / "t"), "id string, status string")
    for k in range(7):
        old.commit(k, spark.createDataFrame([(f"j{k % 3}", f"s{k}")], "id string, status string"))
    assert {r["id"]: r["status"] for r in old.read().collect()} == {"j0": "s6", "j1": "s4", "j2": "s5"}
    assert len(old._manifest(7)) <= 3
    new = vs.VersionedTable(spark, old.path, "id string, status string, max_tags int, callback_delivered boolean", defaults=vs.JOB_DEFAULTS)
    assert all(r["max_tags"] == 8 and r["callback_delivered"] is False for r in new.read().collect())


def test_outbox_over_batches(spark, tmp_path):
    kind = "id string, job_type string, status string, result_json string, error string, callback_url string, callback_delivered boolean"
    rows = [
        ("ok", "p", "completed", "{}", None, "https://x/ok", False), ("slow", "p", "failed", None, "bad", "https://x/slow", False),
        ("dead", "p", "completed", "{}", None, "https://x/dead", False), ("no", "p", "completed", "{}", None, "https://x/no", False),
        ("url", "p", "completed", "{}", None, "ftp://x", False), ("told", "p", "completed", "{}", None, "https://x/t", True),
        ("run", "p", "moderating", None, None, "https://x/r", False),
    ]
    jobs = spark.createDataFrame(rows, kind)
    box = ob.outbox_table(spark, str(tmp_path / "outbox"))
    box.update(lambda now: ob.posted(jobs, now, NOW))
    log = tmp_path / "log"
    log.mkdir()

    def post(url, payload):
        name = url.rsplit("/", 1)[1]
        with (log / name).open("a") as f:
            f.write(payload + "\n")
        tries = len((log / name).read_text().splitlines())
        if name == "dead":
            raise OSError("no answer")
        return {"ok": 200, "slow": 503 if tries < 3 else 204, "no": 404}[name]

    sent, now = [], NOW
    for seconds in (0, 1, 1, 4, 8, 16, 32, 64, 128, 256, 300, 300):
        now += dt.timedelta(seconds=seconds)
        sent.append(ob.send_due(box, post, now))
    got = {r["id"]: (r["state"], r["attempts"], r["code"]) for r in box.read().collect()}
    assert got == {"ok": ("delivered", 1, 200), "slow": ("delivered", 3, 204), "dead": ("failed", 10, None), "no": ("failed", 1, 404), "url": ("invalid", 0, None)}
    assert sent[:4] == [4, 0, 2, 2] and sent[-1] == 0
    assert '"job_id":"slow"' in (log / "slow").read_text()
    done = {r["id"] for r in ob.delivered_jobs(jobs, box.read()).collect()}
    assert done == {"ok", "slow", "url"}
    assert ob.posted(jobs, box.read(), NOW).count() == 0  # nothing is posted twice


def test_outcomes_go_on_a_version_that_others_made(spark, tmp_path):
    box = ob.outbox_table(spark, str(tmp_path / "outbox"))
    row = lambda k: spark.createDataFrame([(k, "https://x", "{}", 0, NOW, "waiting", None)], ob.OUTBOX_SCHEMA)
    box.commit(0, row("a"))
    other = ob.outbox_table(spark, box.path)
    plain, told = box.commit, []

    def commit(base, changed, whole=False):
        if not told:
            told.append(other.commit(base, row("b")))
        return plain(base, changed, whole)

    box.commit = commit
    assert ob.send_due(box, lambda u, p: 200, NOW) == 1
    assert {r["id"]: r["state"] for r in box.read().collect()} == {"a": "delivered", "b": "waiting"}
