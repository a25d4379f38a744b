"""Connected components of an undirected graph by alternating large-star and small-star steps.

Edges go from the larger node to the smaller one, so a node's least neighbour is known from the edges it is the larger end of:
a large-star step makes one row of an edge, a small-star step at most one of an edge and one of a node, and no edge is listed
in both directions. Both steps are a grouped minimum (combined before the shuffle) and a join with the edges; no neighbour
list is ever gathered. Nodes with more than a five-hundredth of all edges, of which there are at most 500, get their minimum
by a broadcast, so that the centre of a large star is not one task's work. The number of rounds grows with the logarithm of
the longest path. Each round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A node is a centre if it has more than this share of the edges, and at least so many.
CENTRE_SHARE, CENTRE_LEAST = 500, 1000


def _least(edges: DataFrame) -> DataFrame:
    """(n, m): the least neighbour of each node that is the larger end of an edge. Any other node is smaller than its neighbours."""
    return edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))


def _with_least(edges: DataFrame, end: str, low: DataFrame, count: int) -> DataFrame:
    """edges(a, b) with m of low(n, m) for the node at that end, null for a node without one."""
    limit = max(CENTRE_LEAST, count // CENTRE_SHARE)
    centres = edges.groupBy(F.col(end).alias("n")).agg(F.count("*").alias("degree")).where(F.col("degree") > limit).select("n")
    centres = F.broadcast(centres.join(low, "n", "left"))  # at most CENTRE_SHARE rows
    on = F.col(end) == F.col("n")
    return edges.join(centres, on).union(edges.join(centres, on, "left_anti").join(low, on, "left"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours. Edges have a > b."""
    out = _with_least(edges, "b", _least(edges), count)
    return out.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of those. Edges have a > b."""
    low = _least(edges)
    moved = _with_least(edges, "a", low, count).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("n", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): one row for each node that has an edge, root the smallest node it reaches.

    Self loops and nulls are ignored; repeated edges and both directions are allowed; no edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # The stars are final when every node has one parent and no parent has a parent: then the steps change nothing.
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
        now = cut(_small_star(cut(_large_star(now, state[0])), state[0]))
