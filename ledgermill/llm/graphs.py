"""Connected components of large graphs, without a node or component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """The smallest id reachable from each id of the edges (a, b): id, component.

    Alternates the two star operations until nothing changes: first each node's larger
    neighbours are tied to its smallest neighbour, then each node's smaller neighbours. The
    number of rounds grows with the logarithm of the longest path. Minima are aggregated before
    the shuffle, written, and joined back, so both sides of the join are shuffled and adaptive
    execution splits a node with a very long neighbour list. Each round's edges are a written table.
    """
    pairs = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct()
    current = stage(pairs.select("a", "b"), "components")
    mark = _mark(current)
    while mark[0]:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written before they are joined back: as planned, the aggregate is already
        # dealt by node, the join shuffles only the edges, and a hub stays in one task.
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components-least")
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "components")
        small_least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        tied = large.join(small_least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stage(tied.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "components")
        before, mark = mark, _mark(current)
        if before == mark:
            break
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
