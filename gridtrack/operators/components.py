"""Connected components of an edge table, wholly in Spark.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014).  Each round is two grouped minima and two joins; the edges of a
round are written to the shared folder, so lineage stays short.  Nothing is collected: the
driver only sees two sums that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridtrack import scratch


def _star(both: DataFrame, large: bool) -> DataFrame:
    """One round over ``both(u, v)``; the hub of u is the smallest of u and its neighbours."""
    if not large:
        both = both.where("v < u")
    hub = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(hub, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        hub.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Return ``(node, root)`` for every node of an edge, root the smallest node of its component.

    Nodes are any orderable type.  Null ends, loops and repeated edges are ignored; nodes without
    an edge don't appear (they are their own root); an empty table gives an empty result.
    Hot nodes: the minimum is pre-aggregated on the map side, and the join back is an equi-join
    that adaptive execution may split.
    """
    now = scratch.table(_clean(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        big = _clean(_star(both, True))
        new = scratch.table(_clean(_star(big.select(F.col("a").alias("u"), F.col("b").alias("v")), False)), "edges")
        state = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        scratch.drop(now)
        now = new
        if state == seen or not state["n"]:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
