"""Connected components by alternating star contraction, with plain joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WorkTables


def _state(edges: DataFrame):
    """Row count and an order-free fingerprint of the edges; both fit one row whatever the number of edges."""
    return edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum((F.xxhash64("a", "b") % 1_000_003)).alias("s")
    ).first()


def components(edges: DataFrame, tables: WorkTables) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type).

    The component is its smallest node. Each round turns the edges into shorter stars, so the number of
    rounds grows with the logarithm of the longest path. Degrees are folded by grouped minima (map-side first)
    and joined back; no neighbour list is gathered. Self-loops and repeated edges are fine; no edges: no rows.
    """
    edges = tables.write(
        "edges-0",
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
    )
    before = _state(edges)
    turn = 0
    while before["n"]:
        turn += 1
        # Every larger neighbour of a node points to the smallest node in reach of one step.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # Then every smaller neighbour of a node, and the node itself, point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = tables.write(f"edges-{turn}", small)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
