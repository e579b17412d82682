"""Connected components of an edge table by alternating large-star and small-star steps.

Edges point from the larger node to the smaller one and stay distributed.  A step takes the least
neighbour of each node, combined before the shuffle, and joins it to the edges of the node.  The edges of
a hub don't meet in that join: a node with more than a HUBS-th of all edges (at most 2 x HUBS nodes can
have so many) takes its least neighbour from a broadcast table.  What a round wrote is deleted once the
next round is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: A hub has at least HUB_EDGES edges and more than a HUBS-th of all.
HUB_EDGES, HUBS = 1000, 500


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _hubs(edges: DataFrame, n: int) -> list[int]:
    """Nodes with so many edges that they must not meet in one task: at most 2 x HUBS."""
    if n <= HUB_EDGES:
        return []
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return [r["node"] for r in ends.where(F.col("n") > max(HUB_EDGES, n // HUBS)).collect()]


def _with_least(edges: DataFrame, end: str, least: DataFrame, hubs: list[int]) -> DataFrame:
    """The edges with m, the least neighbour of their node `end` (null if it has none that is smaller)."""
    out = edges.join(least, F.col(end) == F.col("node"), "left") if not hubs else edges.where(~F.col(end).isin(hubs)).join(least, F.col(end) == F.col("node"), "left")
    if hubs:
        few = F.broadcast(least.where(F.col("node").isin(hubs)))
        out = out.union(edges.where(F.col(end).isin(hubs)).join(few, F.col(end) == F.col("node"), "left"))
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v (long, not null).  Returns node, component: its least reachable node.

    Every node that isn't the least of its component has one row.  Loops and repeated edges do no harm;
    an empty table gives no rows.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = _state(edges)
    while state[0]:
        hubs = _hubs(edges, state[0])
        least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = _with_least(edges, "v", least, hubs).select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = _with_least(large, "u", least, hubs).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(least).distinct())
        drop(edges)
        edges, before = after, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
