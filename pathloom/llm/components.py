"""Connected components of links between documents, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (a, b).

    Every round points the larger neighbours of each node to its smallest one,
    then the smaller neighbours likewise, until nothing changes; the number of
    rounds grows with the logarithm of the component, not with its diameter.
    Only minima are formed per node, so a node with very many links is no hot
    group; each round's links are a written table. Nulls, self-links and repeated
    links are ignored.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(lowest, F.col("u") == F.col("_u")).filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        large = materialize(large, "links")
        smallest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(smallest, F.col("u") == F.col("_u")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter(F.col("u") > F.col("v")).distinct()
        edges = materialize(small, "links")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
