"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.sources.scratch import settle


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (columns a and b, not null).

    Each round every node adopts the neighbour, or itself, that is first in a fixed random order, edges are
    rewritten to the adopted nodes, and edges inside a node vanish; stars go in two rounds, paths shrink by a
    factor. Groupings combine before they shuffle; joins have two written sides, so that adaptive execution
    splits a node with very many edges. Each round's tables are written, so a lost executor costs one stage.
    """
    order = lambda column: F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("node"))
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("first"))
        adopted = settle(
            first.select(F.col("a").alias("node"), F.least("first", order("a")).getField("node").alias("to")), "adopted"
        )
        further = adopted.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jumped = settle(adopted.join(further, "to", "left").select("node", F.coalesce("then", "to").alias("to")), "adopted")
        maps.append(jumped)
        left = jumped.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = jumped.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = settle(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = maps[0]
    for later in maps[1:]:
        ends = ends.join(later.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", "left")
        ends = ends.select("node", F.coalesce("then", "to").alias("to"))
    ends = settle(ends, "ends")
    least = ends.groupBy("to").agg(F.min("node").alias("component"))
    return ends.join(least, "to").select("node", "component")
