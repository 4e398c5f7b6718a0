"""Connected components of an edge table, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartloom.llm.common import cut


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round moves every node's larger neighbours, then its smaller ones, to the smallest of them. Both steps are
    grouped minima with map-side partials and a join, so a hub with very many neighbours is never gathered in a task.
    Self-links and nulls are left out; an empty table gives an empty table.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(moved.select("e.u", "e.v").filter("u > v").distinct())
        # a forest of stars has no node that is both a leaf and a centre, and one centre for each leaf
        tall = after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        wide = after.groupBy("u").count().filter("count > 1").limit(1).count()
        edges = after
        if not tall and not wide:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
