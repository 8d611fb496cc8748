"""Connected components in Spark, by alternating large and small stars.

Each round points every node at the least node it knows of; only sums and minima of a node's
neighbours are taken, never their list. Behind the joins comes another shuffle anyway, so Spark's
adaptive execution may deal a node with very many links to several tasks; a round is two jobs, as
the driver remembers stages and tasks of each. The links of a round are cut off from their past by a
reliable checkpoint, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """The components of an undirected graph.

    ``edges`` has a row for each link; both columns have one orderable type. Returns ``node`` and
    ``root``, the least node that it reaches, for each node that has a link to another node. Links
    of a node to itself and rows with a null are ignored, repeated links count once, an empty
    table gives an empty one.
    """
    a, b = F.col(left), F.col(right)
    links = cut(edges.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())
    state = _state(links)
    while state[0]:
        both = links.union(links.select("low", "high")).toDF("at", "to")
        least = both.groupBy("at").agg(F.min("to").alias("m")).select("at", F.least("at", "m").alias("m"))
        large = both.join(least, "at").where(F.col("to") > F.col("at")).select(F.col("to").alias("high"), F.col("m").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").where(F.col("low") != F.col("m")).select(F.col("low").alias("high"), F.col("m").alias("low"))
        links = cut(small.union(least.select("high", F.col("m").alias("low"))).distinct())
        before, state = state, _state(links)
        if state == before:
            break
    nodes = links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return nodes.union(links.select("low", "low").distinct())
