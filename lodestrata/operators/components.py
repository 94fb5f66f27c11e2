"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.tables import written


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and sum of the 64-bit hashes: two rounds that agree in both have the same edges."""
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Alternates the large-star and the small-star step, each a grouped minimum
    joined back to the edges, so no group is ever gathered and a hub costs as
    much as its edges.  Every round is written to the shared folder, which cuts
    the lineage.  Loops and repeated edges are fine, nulls are dropped, an empty
    table gives an empty one.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    loops = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    before = _state(now)
    for turn in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = written(linked.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.join(now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))).distinct(), "node", "left_anti")
    return star.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))
