"""Near-duplicate documents by SetSketch registers, likelihood estimates and exact confirmation.

A document's set holds the hashes of its distinct word shingles. Every element of a set sends points to the registers
at exponentially spaced times; a register keeps the least time, truncated at a horizon that leaves none empty, on a
logarithmic scale of base BASE. Registers are mergeable by maximum, and two sets' registers agree about as often as
their Jaccard similarity says.

1. Documents with equal sets are one node. 2. Bands of registers are hashed; nodes that share a band value are
candidates. 3. Each node is compared with a hub, the node that shares bands with most others, that it shares most bands
with; then all nodes that bands connect but links don't are compared, block by block. A comparison estimates the
similarity from both registers by likelihood and, unless that is far below the threshold, counts both full sets.
4. Links make components.

With BANDS bands of ROWS registers a pair at similarity 0.8 is missed with a probability near 1e-6; the estimate's
margin is five standard deviations. Documents without words or with null text have an empty set and link with nothing;
documents with fewer words than a shingle have one shingle, all their words. Repeated rows are exact copies; null ids
count as the smallest; columns other than id and text are ignored by ``near_duplicates``. Rows are told apart by id and
a hash of the text, so ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.graph import components
from brindle.llm.text import alone
from brindle.staging import bounded_batches, stage, stage_counted

REGISTERS, BASE, OFFSET = 256, 1.001, 4000
BANDS, ROWS = 96, 8
HORIZON = 12.0
#: Estimates below the threshold by more than this aren't confirmed.
MARGIN = 0.15
#: Rows up to which a table of ids is broadcast, some 8 MB in each executor for each join, which stay there until the
#: driver collects its garbage; longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: A hub's comparisons are dealt to so many parts.
HUB_PARTS = 32
#: Rounds of comparisons with hubs: at least, and at most while more than FEW nodes are apart in a shared band and the
#: rounds still help; nodes in a block of a family.
HUB_ROUNDS, MOST_ROUNDS, FEW, BLOCK = 2, 8, 20_000, 192
REMEMBERED = 400_000
_LEAST = -(1 << 63)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> _S30)) * _C2
    x = (x ^ (x >> _S27)) * _C3
    return x ^ (x >> _S31)


_KNOWN: dict[bytes, int] = {}


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = alone(_KNOWN)
    found = list(map(known.get, words))
    if None in found:
        if len(known) > REMEMBERED:
            known.clear()
        for k, v in enumerate(found):
            if v is None:
                found[k] = xxhash.xxh64_intdigest(words[k])
                if len(words[k]) <= 64:
                    known[words[k]] = found[k]
    h = np.array(found, np.uint64)
    n = max(1, len(h) - width + 1)
    out = h[:n].copy()
    for j in range(1, min(width, len(h))):
        out = _mix(out * _C1 + h[j : j + n])
    return np.unique(_mix(out + np.uint64(min(width, len(h)))))


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """[set, register]: the SetSketch registers of non-empty sets, as 16-bit integers.

    An element's points come at exponential gaps of mean 1 / m, each to a register drawn at random, so that each
    register gets points at rate 1 from each element. Only times up to HORIZON / size are drawn; a set with an empty
    register is drawn again with twice the horizon.
    """
    least = np.full((len(sets), m), np.inf)
    todo, horizon = np.arange(len(sets)), np.array([HORIZON / len(s) for s in sets])
    while len(todo):
        h = np.concatenate([sets[k] for k in todo])
        own = np.repeat(todo, [len(sets[k]) for k in todo])
        limit = np.repeat(horizon[todo], [len(sets[k]) for k in todo])
        time = np.zeros(len(h))
        step = np.zeros(1, np.uint64)
        while len(h):
            step += _C1
            r = _mix(h + step)
            time = time - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / m
            kept = time <= limit
            h, own, limit, time, r = h[kept], own[kept], limit[kept], time[kept], r[kept]
            np.minimum.at(least.reshape(-1), own * m + (r & np.uint64(m - 1)).astype(np.int64), time)
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        horizon[todo] *= 2
    scale = np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)) + OFFSET
    return np.clip(scale, 0, 65535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, points: int = 201) -> float:
    """The most likely Jaccard similarity of two sets of known sizes, given both register arrays.

    By the share of registers that are greater, less and equal: p(x) = -log_BASE(1 - x (BASE - 1) / BASE) is the
    probability that the first is greater, at x = u - v J, with u and v the sizes' shares.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    more, less = int((a > b).sum()), int((a < b).sum())
    j = np.linspace(0, min(u / v, v / u), points)
    p = lambda x: np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    pa_, pb_ = p(u - v * j), p(v - u * j)
    equal = np.maximum(1 - pa_ - pb_, 1e-12)
    return float(j[np.argmax(more * np.log(pa_) + less * np.log(pb_) + (len(a) - more - less) * np.log(equal))])


def _band_places() -> np.ndarray:
    return np.argsort(np.random.RandomState(7).rand(BANDS, REGISTERS), axis=1)[:, :ROWS]


def band_values(sketches: np.ndarray) -> np.ndarray:
    """[set, band]: a hash of each band's registers."""
    places = _band_places()
    out = np.zeros((len(sketches), BANDS), np.uint64)
    for k in range(ROWS):
        out = _mix(out * _C1 + sketches[:, places[:, k]].astype(np.uint64))
    return _mix(out + np.arange(BANDS, dtype=np.uint64) * _C1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of full sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST))


def sketch_documents(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, node, sketch, mark) per document; node (a hash of the set) and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(1)]
            full = [k for k, s in enumerate(sets) if len(s)]
            node: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            at = 0
            while at < len(full):  # about 200,000 elements at once
                end, size = at, 0
                while end < len(full) and (end == at or size + len(sets[full[end]]) <= 200_000):
                    size += len(sets[full[end]])
                    end += 1
                group = full[at:end]
                for k, r in zip(group, registers([sets[k] for k in group])):
                    node[k] = int(np.uint64(xxhash.xxh3_64_intdigest(sets[k].tobytes())).astype(np.int64))
                    sketch[k] = r.tobytes()
                at = end
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), b.column(2)],
                names=["doc_id", "n", "node", "sketch", "mark"],
            )

    rows = docs.select(_key(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return rows.mapInArrow(run, "doc_id long, n long, node long, sketch binary, mark long")


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, node) for each node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes_ = b.column(0).to_numpy()
            sketches = np.stack([np.frombuffer(s.as_py(), np.uint16) for s in b.column(1)]) if len(nodes_) else None
            if sketches is not None:
                values = band_values(sketches).view(np.int64)
                yield pa.RecordBatch.from_pydict({"band": values.reshape(-1), "node": np.repeat(nodes_, BANDS)})

    return nodes.select("node", "sketch").mapInArrow(run, "band long, node long")


def _sized(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a staged table, with the hint to broadcast it if it is short."""
    staged, seen = stage_counted(df, name)
    return F.broadcast(staged) if seen["n"] <= BROADCAST_ROWS else staged


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are linked. ``texts`` has node, n, sketch and text of all nodes in pairs.

    Pairs are dealt by u and a part of v; each such group reads u's text once and then compares it with one v after
    the other, so a hub's group needs no memory and its parts go to different tasks.
    """
    pairs = pairs.withColumn("part", F.pmod(F.col("v"), F.lit(HUB_PARTS)).cast("int"))
    pairs = _sized(pairs, "pairs")
    hubs = _sized(pairs.select("u", "part").distinct(), "hubs")
    members = texts.join(pairs, texts["node"] == pairs["v"]).withColumn("role", F.lit(1))
    centres = texts.join(hubs, texts["node"] == hubs["u"]).withColumn("role", F.lit(0))
    columns = ["u", "part", "role", "node", "n", "sketch", "text"]
    rows = centres.select(*columns).unionByName(members.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            found = []
            for u, role, node, n, sketch, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))):
                r = np.frombuffer(sketch, np.uint16)
                if role == 0:
                    own = (n, r, text, None)
                    continue
                n_u, r_u, text_u, set_u = own
                if 100 * min(n, n_u) < percent * max(n, n_u):
                    continue
                if estimate(r_u, r, n_u, n) < percent / 100 - MARGIN:
                    continue
                if set_u is None:
                    set_u = shingles(text_u, width)
                    own = (n_u, r_u, text_u, set_u)
                if linked(set_u, shingles(text, width), percent):
                    found.append((u, node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"]
            )

    dealt = rows.repartition("u", "part").sortWithinPartitions("u", "part", "role", "node")
    return stage(dealt.mapInArrow(run, "u long, v long"), "links")


def connect(shared: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, comp) of the nodes in bands with others (band, node, degree); nodes without links may be missing.

    In each round a node is compared with one hub that it shares bands with and isn't connected to: a
    band's hub is its node of the greatest degree, as the text that copies were made from shares bands with most of
    them. What is still apart in a shared band then goes to ``compare_families``, whose work grows with the square of a
    family, so rounds go on while they help.
    """
    links, comps, last = None, None, None
    for turn in range(MOST_ROUNDS + 1):
        placed = shared.withColumn("comp", F.col("node"))
        if comps is not None:
            placed = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = (
            placed.groupBy("band")
            .agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max(F.struct("degree", "node", "comp")).alias("t"))
            .filter("a <> b")
            .select("band", F.col("t.node").alias("hub"), F.col("t.comp").alias("hub_comp"))
        )
        placed = stage(placed.join(_sized(mixed, "mixed"), "band"), "placed")
        if turn >= HUB_ROUNDS:
            apart = placed.select("node").distinct().count()
            if turn == MOST_ROUNDS or apart <= FEW or last is not None and apart > 0.9 * last:
                break
            last = apart
        counts = placed.filter("comp <> hub_comp").groupBy("node", "hub").agg(F.count("*").alias("k"))
        best = F.max(F.struct("k", "hub"))["hub"].alias("u")
        found = confirm(counts.groupBy("node").agg(best).select("u", F.col("node").alias("v")), texts, width, percent)
        links = found if links is None else links.unionByName(found)
        comps = _sized(components(links), "comps")
    links = links.unionByName(compare_families(placed, texts, width, percent))
    return stage(components(links), "comps")


def compare_families(placed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between nodes of different components in families: nodes that bands connect. No pair becomes a row.

    A family is cut into blocks of about BLOCK nodes by a hash, and every two blocks meet in one task, which compares
    registers first, estimates and confirms, and skips pairs that its links so far (and the known components) connect.
    """
    families = components(placed.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    families = _sized(families.withColumnRenamed("comp", "family"), "families")
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    own = placed.groupBy("node").agg(F.min("comp").alias("comp")).join(families, "node").join(sizes, "family")
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    dealt = _sized(own.select("family", F.col("node").alias("v"), "comp", "own", one, two), "dealt")
    rows = texts.join(dealt, texts["node"] == dealt["v"])

    def compare(block: pa.Table) -> pa.Table:
        rows_ = sorted(
            zip(*(block[c].to_pylist() for c in ("node", "comp", "own", "n", "sketch", "text"))), key=lambda r: r[0]
        )
        one = block["one"][0].as_py()
        same = one == block["two"][0].as_py()
        r = np.stack([np.frombuffer(x[4], np.uint16) for x in rows_])
        n = np.array([x[3] for x in rows_])
        left = np.array([x[2] == one for x in rows_])
        parent: dict[int, int] = {x[1]: x[1] for x in rows_}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        sets: dict[int, np.ndarray] = {}

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(rows_[k][5], width)
            return sets[k]

        found = []
        for i in np.flatnonzero(left).tolist():
            agree = (r == r[i]).sum(axis=1) >= (percent / 100 - MARGIN) * REGISTERS
            agree &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
            agree &= (np.arange(len(n)) > i) if same else ~left
            for k in np.flatnonzero(agree).tolist():
                a, b = root(rows_[i][1]), root(rows_[k][1])
                if a == b or estimate(r[i], r[k], int(n[i]), int(n[k])) < percent / 100 - MARGIN:
                    continue
                if linked(full(i), full(k), percent):
                    parent[a] = b
                    found.append((rows_[i][0], rows_[k][0]))
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return stage(rows.groupBy("family", "one", "two").applyInArrow(compare, "u long, v long"), "links")


def _judged(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, mark, n, component_id, stays) per row; ``stays`` holds for the component's least (doc_id, mark)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = stage(sketch_documents(docs, width, doc_id, text), "sketches")
    full = found.filter("node IS NOT NULL")
    nodes = stage(
        full.groupBy("node").agg(
            F.min(F.struct("doc_id", "mark")).alias("first"), F.first("n").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")
        ).select("node", F.col("first.doc_id").alias("first"), F.col("first.mark").alias("mark"), "n", "sketch"),
        "nodes",
    )
    bands = stage(_bands(nodes), "bands")
    # aggregates are staged before they are joined back, so that a band or node with very many rows can be split
    several = stage(bands.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1"), "counts")
    shared = stage(bands.join(several, "band"), "several")  # nodes in bands with others
    degrees = stage(shared.groupBy("node").agg(F.sum(F.col("k") - 1).alias("degree")), "degrees")
    shared = stage(shared.join(degrees, "node").select("band", "node", "degree"), "shared")
    involved = stage(degrees.select("node").join(nodes, "node"), "involved")
    keys = _sized(involved.select("first", "mark", "node"), "keys")
    rows = docs.select(_key(doc_id).alias("first"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    comps = connect(shared, _texts_of(rows, keys, involved, width), width, percent)
    labels = nodes.select("node", "first", "mark").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labels = stage(labels, "labels")
    least = stage(labels.groupBy("comp").agg(F.min(F.struct("first", "mark")).alias("least")), "least")
    labels = stage(
        labels.join(least, "comp").select(
            "node", F.col("least.first").alias("component_id"), F.col("least.mark").alias("least_mark")
        ),
        "labels",
    )
    out = found.select("doc_id", "n", "node", "mark").join(labels, "node", "left")
    return out.select(
        "doc_id",
        "mark",
        "n",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("least_mark"))).alias("stays"),
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that its links reach), kept (is that its own)."""
    out = _judged(docs, width, percent, doc_id, text)
    return out.select(
        F.when(F.col("doc_id") != _LEAST, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("component_id") != _LEAST, F.col("component_id")).alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def _texts_of(rows: DataFrame, keys: DataFrame, involved: DataFrame, width: int) -> DataFrame:
    """node, n, sketch and one text of each involved node, staged.

    Texts are found by the node's first doc_id and that row's text hash, and their sets compared with the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [
                int(np.uint64(xxhash.xxh3_64_intdigest(shingles(t, width).tobytes())).astype(np.int64)) == k
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            ]
            yield b.filter(pa.array(keep, pa.bool_()))

    joined = rows.join(keys, ["first", "mark"]).select("node", "text")
    own = stage(joined.mapInArrow(run, "node long, text string").dropDuplicates(["node"]), "texts")
    return stage(own.join(involved.select("node", "n", "sketch"), "node"), "node_texts")


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group, the one with the least doc_id, with the columns of ``docs``.

    Rows are judged by id and text: of a group's rows with its least id, the one with the least text hash stays; rows
    of one id, or none, whose texts are no near duplicates all stay; of rows that repeat both id and text one stays,
    if any.
    """
    found = stage(_judged(docs, width, percent, doc_id, text).select("doc_id", "mark", "stays"), "verdicts")
    rows, keys = found.agg(F.count("*"), F.count_distinct("doc_id", "mark")).first()
    dropped = found.filter("NOT stays").distinct()
    dropped = dropped.select(F.col("doc_id").alias("_dropped_id"), F.col("mark").alias("_dropped_mark"))
    dropped = _sized(dropped, "dropped")
    own, mark = _key(doc_id), F.xxhash64(text)
    out = docs.join(dropped, (own == dropped["_dropped_id"]) & (mark == dropped["_dropped_mark"]), "left_anti")
    if rows == keys:
        return out
    columns = [F.col(c) for c in docs.columns]
    out = out.select(F.struct(*columns).alias("row"), own.alias("id"), mark.alias("mark")).dropDuplicates(["id", "mark"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
