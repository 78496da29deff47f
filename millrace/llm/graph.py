"""Connected components of an undirected graph as DataFrame work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge (a, b); root is some vertex of v's
    component, the same for all of them.

    Each round points every vertex to the first of its neighbours and itself by
    a hash of the id, and contracts the edges along the pointers.  Every part
    that still has an edge loses a vertex, so the loop ends; stars vanish in two
    rounds and long chains shrink by a constant factor.  In the end the pointers
    of all rounds are followed one after another.

    Vertices, edges and pointers stay distributed and are written once per
    round.  Minima are combined before they are shuffled; hot vertices only
    occur as keys of sort-merge joins, which adaptive execution can split, and
    nothing is broadcast.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(_order("b")).alias("n"))
        point = cut(near.select(F.col("a").alias("v"), _first(_order("a"), F.col("n"))["v"].alias("to")))
        half = _follow(live, point, "a")
        after = _follow(half, point, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        rounds.append(point)
        before, live = live, cut(after)
        discard(before)
    if not rounds:
        return live.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = rounds[0].withColumnRenamed("to", "root")
    for point in rounds[1:]:
        roots = roots.join(point.withColumnRenamed("v", "root").hint("merge"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    out = cut(roots)
    discard(live, *rounds)
    return out


def _order(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("v"))


def _first(x: Column, y: Column) -> Column:
    return F.when(x < y, x).otherwise(y)


def _follow(edges: DataFrame, point: DataFrame, end: str) -> DataFrame:
    """``edges`` with one end moved along its pointer."""
    other = "b" if end == "a" else "a"
    moved = edges.join(point.withColumnRenamed("v", end).hint("merge"), end)
    return moved.select(F.col("to").alias(end), other)
