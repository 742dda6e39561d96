"""Connected components by alternating large-star and small-star steps, in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import kept

#: Edges that one task keeps, about: few edges are few files, however many partitions a shuffle has.
EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: nodes a, b (long), any order, repeats allowed. Returns node, root (its smallest node).

    Nodes without edges don't appear. Each step joins the edges with each node's smallest
    neighbour, which is kept first, so that nothing but the join is in its stage and Spark can split
    a node with many edges; every round is kept in the shared folder, in as many parts as its edges ask for. Ends when a round changes nothing, after about log(nodes) rounds.
    """
    given = kept(edges)
    tasks = max(8, -(-given.count() // EDGES))
    edges = kept(given.coalesce(tasks).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(tasks))
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = kept(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct().coalesce(tasks))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
