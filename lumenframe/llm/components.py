"""Connected components of a graph of edges, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge: the smallest node reachable. Nodes are integers.

    Alternates the two star steps until every component is a star around its smallest node; the number of rounds grows with the
    logarithm of the longest path. Every step is a grouped minimum and a join; nothing is gathered per node. Each round is written to the
    shared folder.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = settle(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("degree")))
        # Stars: a node with a smaller neighbour has no other one, so that neighbour has none that is smaller still.
        if least.where("least < u and degree > 1").isEmpty():
            break
        least = least.select("u", F.least("least", "u").alias("m"))
        # Large star: larger neighbours of a node move to the least of its neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = settle(small.where("u <> v").distinct())
    return least.select(F.col("u").alias("node"), F.least("least", "u").alias("component"))
