"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, in order. Inverted lists hold the vectors of each reference point; two
vectors that share enough of them are candidates, and candidates are verified by their cosine in double precision.

* Equal vectors are one class with its number of rows from the start.
* Reference points are spread over a bounded sample by farthest-first choice, so that a dense group doesn't attract them.
* Of ``nearest`` reference points only the rarest ``nearest - shared + 1`` are posted: two vectors that share ``shared`` of
  them share one of these, and their pair is compared in the list of the rarest point that they share, and there only.
* Vectors within half the threshold's angle of the heaviest centre near them form a ball: they are linked to one another by
  the triangle inequality, so no pair of a ball is compared or written, however large it is.
* Lists longer than ``BLOCK`` are cut into blocks of a ball's or of mixed vectors, which meet pair by pair in tasks of their
  own; a ball's blocks don't meet each other. A task writes sums and one edge a vector, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.graph import components
from brindle.staging import bounded_batches, stage

NEAREST, SHARED = 8, 3
LEAST_PIVOTS, MOST_PIVOTS = 256, 4_096  #: reference points: one in 256 classes, within these bounds
SAMPLE_FACTOR = 4  #: sampled vectors a reference point
SAMPLE_NUMBERS = 1 << 23  #: and not more numbers than this in all
CLOSE = 0.8  #: reference points of a higher cosine aren't chosen
BLOCK = 1_024
STEP = 1 << 21  #: numbers that are verified at once


# ---- reference points --------------------------------------------------------------------------------------------------


def spread_points(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` unit vectors: farthest-first from a sample of unit vectors, then random directions."""
    chosen: list[np.ndarray] = []
    if len(sample):
        near = np.full(len(sample), -2.0)
        at = 0
        while len(chosen) < count:
            chosen.append(sample[at])
            near = np.maximum(near, sample @ sample[at])
            at = int(near.argmin())
            if near[at] > CLOSE:
                break
    size = sample.shape[1]
    more = np.random.default_rng(seed + size).normal(size=(count - len(chosen), size))
    more /= np.maximum(np.linalg.norm(more, axis=1, keepdims=True), 1e-300)
    return np.vstack([*chosen, more]) if len(chosen) else more


def _units(rows: list | pa.ListArray) -> np.ndarray:
    held = np.asarray(rows, np.float64)
    held = held / np.maximum(np.abs(held).max(1, keepdims=True), 1e-300)  # squares don't overflow
    return held / np.linalg.norm(held, axis=1, keepdims=True)


class Points:
    """Reference points for each dimension that occurs: of the sample, filled up with random directions."""

    def __init__(self, sampled: list, count: int, least: int):
        self.count, self.least, self.known = count, least, {}
        by_size: dict[int, list] = {}
        for row in sampled:
            by_size.setdefault(len(row), []).append(row)
        for size, rows in by_size.items():
            self.known[size] = spread_points(_units(rows), self._most(size))

    def _most(self, size: int) -> int:
        return max(self.least, min(self.count, SAMPLE_NUMBERS // max(size, 1)))

    def of(self, size: int) -> np.ndarray:
        if size not in self.known:
            self.known[size] = spread_points(np.zeros((0, size)), self._most(size))
        return self.known[size]


def _described(points: Points, nearest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends each vector's nearest reference points in order."""
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index("vec"))
        sizes = np.asarray(vectors.value_lengths())
        out = np.empty((batch.num_rows, nearest), np.int32)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            held = _units(vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, size))
            out[at] = np.argsort(-(held @ points.of(int(size)).T), axis=1, kind="stable")[:, :nearest]
        yield batch.append_column("near", pa.array(list(out), pa.list_(pa.int32())))


# ---- balls -------------------------------------------------------------------------------------------------------------


def _in_ball(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets ``ball`` to null where the vector isn't within reach of its centre, and drops the centre."""
    for batch in batches:
        vectors, centres = batch.column("vec"), batch.column("centre")
        ball = batch.column("ball").to_numpy(zero_copy_only=False).astype(object)
        has = np.asarray(centres.is_valid())
        sizes = np.asarray(vectors.value_lengths())
        inside = np.zeros(batch.num_rows, bool)
        for size in np.unique(sizes[has]):
            at = np.flatnonzero(has & (sizes == size))
            a = _units(vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, size))
            b = _units(centres.take(pa.array(at)).flatten().to_numpy().reshape(-1, size))
            inside[at] = np.einsum("ij,ij->i", a, b) >= least
        ball[~inside] = None
        kept = [n for n in batch.schema.names if n not in ("centre", "ball")]
        columns = [batch.column(n) for n in kept] + [pa.array([None if x is None else int(x) for x in ball], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ball"])


def _balls(described: DataFrame, threshold: float) -> DataFrame:
    """``described`` with ``ball``: the centre whose half-angle neighbourhood holds the vector, or null."""
    head = F.slice("near", 1, 3)
    groups = ["grp", "dim"]
    spots = described.groupBy(*groups, head.alias("head")).agg(F.count("*").alias("n"), F.min_by("vec", "cid").alias("centre"), F.min("cid").alias("ball"))
    spots = spots.filter("n > 1").select(*groups, "n", "centre", "ball", F.explode("head").alias("first"))
    best = F.max_by(F.struct("centre", "ball"), F.struct("n", -F.col("ball"))).alias("best")
    centres = stage(spots.groupBy(*groups, "first").agg(best).select(*groups, "first", "best.*"), "centres")
    joined = described.withColumn("first", F.col("near")[0]).join(centres, [*groups, "first"], "left")
    joined = joined.select(*described.columns, "centre", "ball")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in described.schema) + ", ball long"
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-7
    return joined.mapInArrow(partial(_in_ball, half), schema)


# ---- inverted lists ----------------------------------------------------------------------------------------------------


def _postings(described: DataFrame, order: np.ndarray, rarest: int) -> DataFrame:
    """(grp, dim, lst, cid, ball, mult, vec, ranks): a row for each of the rarest reference points; ``ranks`` are all, rarest
    first."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in described.schema).replace("near ", "ranks ", 1)
    ranked = described.mapInArrow(partial(_ranked, order), schema)
    posted = F.explode(F.slice("ranks", 1, rarest)).alias("lst")
    return ranked.select("grp", "dim", posted, "cid", "ball", "mult", "vec", "ranks")


def _ranked(order: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reference points as ranks by frequency, the rarest first."""
    for batch in batches:
        near = batch.column("near")
        ranks = np.sort(order[near.flatten().to_numpy().reshape(batch.num_rows, -1)], axis=1).astype(np.int32)
        at = batch.schema.get_field_index("near")
        yield batch.set_column(at, "ranks", pa.array(list(ranks), pa.list_(pa.int32())))


def _blocked(posted: DataFrame, block: int) -> DataFrame:
    """A row for each pair of blocks (lo, hi) of a list in which a posting takes part, and which of them it is in (blk)."""
    key = ["grp", "dim", "lst"]
    sizes = posted.groupBy(*key, F.coalesce("ball", F.lit(-1)).alias("ball")).agg(F.count("*").alias("n"))
    pool = F.when(F.col("n") >= block, F.col("ball")).otherwise(-1).alias("pool")
    pools = sizes.select(*key, pool, "n").groupBy(*key, "pool").agg(F.sum("n").alias("n"))
    pools = pools.select(*key, "pool", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    long = pools.groupBy(*key).agg(F.sum("blocks").alias("all"), F.sort_array(F.collect_list(F.struct("pool", "blocks"))).alias("pools"))
    long = stage(long.filter("all > 1"), "long_lists")
    if long.isEmpty():
        zero = F.lit(0)
        return posted.select("*", zero.alias("lo"), zero.alias("hi"), zero.alias("blk"))
    joined = posted.join(long, key, "left")
    own = F.filter("pools", lambda p: p.pool == F.coalesce("ball", F.lit(-1)))
    pure = F.size(own) > 0
    own = F.when(pure & F.col("ball").isNotNull(), own[0]).otherwise(F.filter("pools", lambda p: p.pool == -1)[0])
    joined = joined.withColumn("own", own)
    before = F.aggregate(F.filter("pools", lambda p: p.pool < F.col("own.pool")), F.lit(0), lambda a, p: a + p.blocks)
    joined = joined.withColumn("base", before)
    blk = F.col("base") + F.pmod(F.xxhash64("cid"), F.col("own.blocks")).cast("int")
    joined = joined.withColumn("blk", F.when(F.col("all").isNull(), 0).otherwise(blk))
    alone = F.col("own.pool") >= 0
    partners = F.filter(
        F.sequence(F.lit(0), F.col("all").cast("int") - 1),
        lambda b: ~alone | (b < F.col("base")) | (b >= F.col("base") + F.col("own.blocks")),
    )
    partners = F.when(F.col("all").isNull(), F.array(F.lit(0))).otherwise(partners)
    met = joined.withColumn("met", F.explode(partners))
    return met.select(*posted.columns, F.least("blk", "met").alias("lo"), F.greatest("blk", "met").alias("hi"), "blk")


_LINKS = "cid long, links long, root long"


def _verified(threshold: float, shared: int, table: pa.Table) -> pa.Table:
    """Links within one pair of blocks of one list: (cid, rows linked, least class in reach)."""
    n = table.num_rows
    empty = pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if n < 2:
        return empty
    table = table.combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    cid, mult, blk = (column(c).to_numpy() for c in ("cid", "mult", "blk"))
    ball = column("ball").fill_null(-1).to_numpy()
    here, size = column("lst")[0].as_py(), column("dim")[0].as_py()
    within = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    ranks = column("ranks").flatten().to_numpy().reshape(n, -1)
    points, which = np.unique(ranks, return_inverse=True)
    member = np.zeros((n, len(points)), np.float32)
    member[np.arange(n)[:, None], which.reshape(n, -1)] = 1
    units = _units(column("vec").flatten().to_numpy().reshape(n, size))
    rarer = int(np.searchsorted(points, here))
    links, root = np.zeros(n, np.int64), np.arange(n)
    linked: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, n, 512):  # rows of the table of shared counts
        rows = slice(low, min(low + 512, n))
        count = member[rows] @ member.T
        ahead = member[rows, :rarer] @ member[:, :rarer].T  # shared points whose list is the pair's
        meet = (count >= shared) & (ahead == 0) & (np.arange(n) > np.arange(n)[rows, None])
        meet &= (ball[rows, None] != ball) | (ball[rows, None] < 0)
        if not within:
            meet &= blk[rows, None] != blk
        a, b = np.nonzero(meet)
        a += low
        step = max(1, STEP // max(size, 1))
        for at in range(0, len(a), step):
            i, j = a[at : at + step], b[at : at + step]
            good = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
            i, j = i[good], j[good]
            if len(i):
                links += np.bincount(i, mult[j], n).astype(np.int64) + np.bincount(j, mult[i], n).astype(np.int64)
                linked.append((i, j))
    if not linked:
        return empty
    i, j = (np.concatenate(x) for x in zip(*linked, strict=True))
    order = np.argsort(cid, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)  # roots are the least class, so labels are places in order of classes
    root = place.copy()
    while True:  # labels spread along links, each round through the labels' own labels
        new = root.copy()
        least = np.minimum(new[i], new[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    some = links > 0
    return pa.table({"cid": cid[some], "links": links[some], "root": cid[order[root[some]]]})


# ---- the operator ------------------------------------------------------------------------------------------------------


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label); other columns are left out.

    Two rows are linked if their labels and numbers of components are equal and their cosine is at least ``threshold``.
    Vectors that are null, empty or zero, or hold null or non-finite components, and those of null labels link with nothing.
    ``n_links`` counts the other rows linked directly, repeated rows and repeated ids each. ``component_id`` is the least
    vec_id in reach; a null id is never it unless no other is in reach. ``kept``: the row has it. An empty table gives none.

    All links above the threshold of vectors that share ``shared`` of ``nearest`` reference points are found; ``pivots`` sets
    their number (else one in 256 classes, from 256 to 4,096).
    """
    if not 1 <= shared <= nearest or not 0 < threshold <= 1:
        raise ValueError("shared must be from 1 to nearest, threshold above 0 and at most 1")
    spark = vectors.sparkSession
    bounded_batches(spark, 2_048)
    rows = vectors.select("vec_id", F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("vec64"), F.col("embedding").alias("vec"))
    finite = F.forall("vec64", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("grp").isNotNull() & F.coalesce(finite & F.exists("vec64", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "grp", "vec", valid.alias("valid"))
    good = rows.filter("valid")
    alike = good.groupBy("grp", "vec").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    classes = stage(alike.select("grp", "vec", "mult", "least", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("cid")), "classes")
    count = pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, classes.count() // 256)))
    largest = classes.agg(F.max("dim")).first()[0] or 1
    bound = max(nearest, min(SAMPLE_FACTOR * count, SAMPLE_NUMBERS // largest))
    sample = [r[0] for r in classes.select("vec", "cid").orderBy(F.xxhash64("cid"), "cid").limit(bound).select("vec").collect()]
    points = Points(sample, count, nearest)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", near array<int>"
    described = stage(classes.drop("least").mapInArrow(partial(_described, points, nearest), schema.replace("least bigint, ", "")), "described")
    described = stage(_balls(described, threshold), "balls")
    often = described.select(F.explode("near").alias("p")).groupBy("p").count().collect()  # one row a reference point
    most = max([count, *(r["p"] + 1 for r in often)])
    frequency = np.zeros(most, np.int64)
    for r in often:
        frequency[r["p"]] = r["count"]
    order = np.empty(most, np.int64)
    order[np.argsort(frequency, kind="stable")] = np.arange(most)
    posted = _postings(described, order, nearest - shared + 1)
    key = ["grp", "dim", "lst", "lo", "hi"]
    blocked = _blocked(posted, block)
    found = stage(blocked.groupBy(*key).applyInArrow(lambda table: _verified(threshold, shared, table), _LINKS), "links")
    inside = described.filter("ball is not null")
    balls = stage(inside.groupBy("ball").agg(F.sum("mult").alias("weight"), F.min("cid").alias("root"), F.count("*").alias("n")), "ball_sizes")
    members = inside.select("cid", "ball", "mult").join(balls.filter("n > 1"), "ball")
    told = found.unionByName(members.select("cid", (F.col("weight") - F.col("mult")).alias("links"), "root"))
    edges = told.select(F.col("cid").alias("u"), F.col("root").alias("v")).filter("u <> v")
    parts = components(edges).withColumnRenamed("node", "cid")
    named = stage(classes.select("cid", "least", "mult").join(parts, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "named")
    ids = stage(named.groupBy("comp").agg(F.min("least").alias("component_id")), "component_ids")
    sums = told.groupBy("cid").agg(F.sum("links").alias("links"))
    judged = named.join(ids, "comp").join(sums, "cid", "left")
    judged = judged.select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    whole = stage(classes.select("grp", "vec", "cid").join(judged, "cid").drop("cid"), "judged")
    out = good.join(whole, ["grp", "vec"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
