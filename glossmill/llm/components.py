"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.sources.workspace import keep


def _least(edges: DataFrame) -> DataFrame:
    """Each edge with the least of its ``node`` and all neighbours of that.

    The least neighbours are a written table, so that the join shuffles both its
    sides by itself, and the many edges of one node can be split as a skewed key.
    """
    least = keep(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("least")), "least")
    return edges.join(least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    return _least(both).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least(edges)
    return (
        down.select(F.explode(F.array("node", "other")).alias("node"), F.col("least").alias("other"))
        .filter("node > other")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has a link to another; the root is the least node.

    Alternating large and small stars: every edge moves towards the least node it
    can see, until all edges of a component meet in one. A round is two sums by
    key and two joins over at most as many edges as before, written to the shared
    folder; the rounds grow with the logarithm of the longest chain. Links in
    either direction, repeated ones and loops are allowed; null ends are ignored.
    """
    known = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = known.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
    edges = keep(edges.filter("node > other").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = keep(_small_star(keep(_large_star(edges), "edges")), "edges")
        if state == (state := _state(edges)):
            break
    roots = edges.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct()
    return edges.select("node", F.col("other").alias("root")).unionByName(roots)
