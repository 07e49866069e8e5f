"""Connected components by alternating star contractions, each half round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the smallest of its neighbourhood; ``moved`` tells a new place.

    Repeated edges may come out, never more than went in.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("u") != F.col("m")).alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ends = edges.join(least, "u").select("m", F.explode(F.array("u", "v")).alias("u"))
    return ends.filter("u != m").select("u", F.col("m").alias("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every node that has a link to another node.

    Links are undirected; loops, nulls and repeated links do no harm. Groups are only ever minima per
    node, so that a node with very many links needs no more memory than others. All is done when every
    upper end of an edge has one lower end, which is below no other: stars around the smallest ids.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = stored(edges, "links")
    for _ in range(rounds):
        large = stored(_large_star(edges), "large-star")
        if not large.agg(F.max("moved")).first()[0]:
            # Every lower end is the smallest around it; what is left to see is whether it is the only one.
            several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
            if several is None or several == 1:
                break
        edges = stored(_small_star(large.select("u", "v")), "links")
    else:
        raise RuntimeError("the components did not settle")
    labels = edges.withColumnRenamed("u", "id").withColumnRenamed("v", "component")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return labels.unionAll(roots.select("id", F.col("id").alias("component")))
