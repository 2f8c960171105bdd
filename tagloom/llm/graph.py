"""Connected components of links that are never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """Each linked node ``u`` with ``v``, the least node reachable; ``links`` has two columns of ids.

    Alternates between hanging a node's greater neighbours and its smaller ones on the least of
    them (large star, small star) until the links no longer change. Minima are pre-aggregated
    before their shuffle, and the joins on a node are plain equi-joins that Spark splits when a
    node has very many links. Nodes without links are not returned.
    """
    first, second = (F.col(c) for c in links.columns)
    edges = links.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v"))
    edges = saved(edges.where("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(least).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now
