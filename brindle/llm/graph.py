"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.staging import short, stage_counted

#: Rows up to which a star's least neighbours are broadcast, which stay in each executor until the driver collects its
#: garbage; longer tables are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """One star step on so many edges (u, v): large joins each node's greater neighbours to its least one, small the others.

    The least neighbours are a staged table, which is broadcast if it is short; else both sides of the join are bare
    shuffles, and adaptive execution can split a node with very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v <= u")
    least = short(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), 2 * rows)
    least, seen = stage_counted(least, "least")
    joined = both.join(F.broadcast(least) if seen["n"] <= BROADCAST_ROWS else least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return short(out.filter("u <> v").distinct(), 2 * rows)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, comp) for each node of the edges (u, v): the least node that it reaches.

    Alternates large and small stars until the edges stay the same; every star is a staged table, and its rows, and what
    tells its edges from the last ones, are summed up while it is written. Few edges are written by few tasks, however
    many partitions shuffles have. Nulls, loops and repeated edges are dropped.
    """
    now, seen = stage_counted(edges.select("u", "v").dropna().filter("u <> v").distinct(), "edges")
    mark, total = None, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
    for _ in range(rounds):
        large, seen = stage_counted(_star(now, seen["n"], True), "star")
        now, seen = stage_counted(_star(large, seen["n"], False), "edges", total)
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return short(own.unionByName(roots), 2 * seen["n"])
