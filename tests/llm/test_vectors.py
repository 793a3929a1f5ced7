"""Near-duplicate vectors against brute force: links, components, recall near the threshold, dense groups and odd rows."""

import math

import numpy as np
import pytest

from brindle.llm import vectors
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """n_links and component_id for each row, in order."""
    groups = {}
    for i, (_, vec, label) in enumerate(rows):
        fine = vec is not None and label is not None and vec and all(x is not None and math.isfinite(x) for x in vec) and any(vec)
        groups.setdefault((label, len(vec)) if fine else ("alone", i), []).append(i)
    out = {}
    for key, at in groups.items():
        if key[0] == "alone":
            out[at[0]] = (0, rows[at[0]][0])
            continue
        units = np.array([rows[i][1] for i in at], float)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        near = units @ units.T >= threshold
        np.fill_diagonal(near, False)
        part = list(range(len(at)))
        for a in range(len(at)):  # depth first
            if part[a] == a:
                todo = [a]
                while todo:
                    for y in np.flatnonzero(near[todo.pop()]):
                        if part[y] > a:
                            part[y] = a
                            todo.append(y)
        for a, i in enumerate(at):
            ids = [rows[at[b]][0] for b in range(len(at)) if part[b] == part[a] and rows[at[b]][0] is not None]
            out[i] = (int(near[a].sum()), min(ids, default=None))
    return sorted(((rows[i][0], *out[i], rows[i][0] == out[i][1]) for i in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def noisy(rng, centre, n, spread):
    return [(centre + rng.normal(size=len(centre)) * spread).astype(np.float32).tolist() for _ in range(n)]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(QUERIES["op11_embedding_dedup"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("block", [8, 1024])
def test_dense_groups_chains_and_copies(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    rows = noisy(rng, centre, 60, 0.05) + noisy(rng, centre, 60, 0.22)  # a ball, and a group as wide as the threshold
    rows += [rows[0]] * 30  # copies
    rows += noisy(rng, rng.normal(size=24), 30, 0.15) + [rng.normal(size=24).tolist() for _ in range(80)]
    rows = [(i, v, i % 7 // 6) for i, v in enumerate(rows)]
    got = found(vectors.near_duplicates(spark.createDataFrame(rows, KIND), block=block, pivots=16))
    rows = [tuple(r) for r in spark.createDataFrame(rows, KIND).collect()]
    want = brute(rows)
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.98 * links > 0
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)


@pytest.mark.parametrize(("nearest", "shared", "least"), [(8, 3, 0.95), (12, 5, 0.95), (4, 4, 0.0)])
def test_recall_just_above_the_threshold(spark, nearest, shared, least):
    rng = np.random.default_rng(9)
    left = rng.normal(size=(1_500, 48))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    turn = rng.normal(size=left.shape)
    turn -= (turn * left).sum(1, keepdims=True) * left
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, size=(1_500, 1))
    right = cosine * left + np.sqrt(1 - cosine**2) * turn
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.vstack([left, right]))]
    df = vectors.near_duplicates(spark.createDataFrame(rows, KIND), nearest=nearest, shared=shared)
    got = df.filter("n_links > 0").count()
    assert got / 3_000 >= least and df.filter("n_links > 1").count() == 0


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [
        (1, a, 1), (1, a, 1), (2, a, 2), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1),
        (7, [1.0, float("nan"), 3.0], 1), (8, [1.0, float("inf"), 3.0], 1), (9, a, None), (None, a, 1), (None, b, 1),
        (None, b, 1), (10, [1.0, 2.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, [-0.0, 1.0, 1.0], 3), (13, [0.0, 1.0, 1.0], 3),
        (14, [1e30, 2e30, 3e30], 1), (-5, [1.0, 2.0, 3.001], 1), (15, [float(i) for i in range(5_000)], 1),
    ]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS cid", "2 AS ball", "3 AS mult", "4 AS n_links", "5 AS near")
    got = vectors.near_duplicates(df)
    assert [c for c, _ in got.dtypes] == ["vec_id", "n_links", "component_id", "kept"]
    assert found(got) == brute([tuple(r) for r in spark.createDataFrame(rows, KIND).collect()])
    assert found(vectors.near_duplicates(df.limit(0))) == []


def test_points_are_spread():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.05
    sample = np.vstack([dense, rng.normal(size=(20, 16))])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    points = vectors.spread_points(sample, 32)
    likeness = points @ points.T - 2 * np.eye(32)
    assert points.shape == (32, 16) and likeness[:20, :20].max() <= 0.81
