"""Connected components of a graph of links, as repeated joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

MAX_ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have a link.

    Alternates the two star operations: every node hands its larger neighbours to the smallest
    one it sees, then its smaller ones. Minima are combined before the shuffle and written, so
    that both sides of the join after them are plain tables and the engine can split a node with
    many neighbours. Neither the links nor a component is ever in one place. Links with a null
    or a repeated end are nothing.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = tx.durable(edges, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = tx.durable(low, "smallest-seen")
        large = edges.select(F.col("v").alias("x"), "u").join(low.withColumnRenamed("u", "x"), "x").select("u", F.col("m").alias("v")).distinct()
        large = tx.durable(large, "large-star")
        low = tx.durable(large.groupBy("u").agg(F.min("v").alias("m")), "smallest-below")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tx.durable(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
    raise RuntimeError("components did not settle")
