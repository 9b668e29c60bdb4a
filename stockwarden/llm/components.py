"""Connected components of a graph given as an edge table.

Each round links every node's larger neighbours to its smallest one, then does the same with the smaller neighbours; the
edges turn into stars. All steps are grouped minima (combined before the shuffle) and equi-joins, which adaptive execution
splits where one node has very many edges. Every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.session import materialize

MAX_ROUNDS = 60


def _stars(near: DataFrame, keep: str) -> DataFrame:
    """From (u, v): the edges (v or u, smallest of u and its neighbours)."""
    least = near.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("k"), F.least("u", "least").alias("least"))
    met = near.join(least, F.col("u") == F.col("k"))
    if keep == "larger":
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("least").alias("b"))
    moved = met.where(F.col("v") != F.col("least")).select(F.col("v").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.where("k != least").select(F.col("k").alias("a"), F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a and b, longs); root is the smallest node reachable.

    Loops and rows with a null end are ignored; repeated edges do no harm; no edges give no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both, "larger").where("a != b").distinct()
        small = _stars(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "all").where("a != b").distinct()
        edges = materialize(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
