"""Connected components of a graph of long ids, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): one row for each node that has a link; equal roots mean the same component, and a
    root is the least node of its component.

    Nodes are renamed by xxhash64, a bijection of longs, so that an order of ids in the data can't slow the
    contraction: each round joins every node to its least neighbour (an aggregation with partial sums, so a hub with
    millions of links is no hot spot), rewrites the links between the nodes that remain and drops loops. About half
    of the nodes go in each round.
    """
    edges = stored(
        links.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")).where("u != v").distinct(), "edges")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.xxhash64("node").alias("at"))
    if edges.isEmpty():
        return nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        up = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("least")).select("w", F.least("w", "least").alias("p"))
        up = stored(up, "up")
        up = stored(
            up.join(up.select(F.col("w").alias("p"), F.col("p").alias("pp")), "p").select("w", F.col("pp").alias("p")), "up")
        labels = stored(
            labels.join(up.withColumnRenamed("w", "at"), "at", "left").select("node", F.coalesce("p", "at").alias("at")), "labels")
        edges = stored(
            edges.join(up.select(F.col("w").alias("u"), F.col("p").alias("pu")), "u")
            .join(up.select(F.col("w").alias("v"), F.col("p").alias("pv")), "v")
            .where("pu != pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            "edges",
        )
    least = labels.groupBy("at").agg(F.min("node").alias("root"))
    return labels.join(least, "at").select("node", "root")
