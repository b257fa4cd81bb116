"""Connected components by alternating star contractions, in joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm import common


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(id, label) of each id in links(a, b): label is the least id that can be reached.

    Each round hooks every id's larger neighbours, then every id itself, onto the least id near it, until
    no edge changes. Least ids come from aggregations that combine before the shuffle and are joined back, so that an id with
    very many links needs no task of its own.
    """
    edges = common.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(near.select("u", F.col("m").alias("v")))
        new = common.stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.dropped(edges)
        edges = new
        if now == before or now[0] == 0:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
