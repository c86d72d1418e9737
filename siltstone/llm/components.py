"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(links: DataFrame, tag: str = "links") -> DataFrame:
    """links (a long, b long) -> one row per node of a link: node, component (the smallest node reachable).

    Every step is a minimum by key and an equi-join, so a node with many links is pre-aggregated and its join is split
    by adaptive execution. Steps end when the links are stars; each is cut and the one before deleted. Each stage costs the
    driver memory, so what is stars already takes no step, and duplicates go once a step.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    while _not_stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))  # as many rows as links
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        then = cut(small, tag)
        forget(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _not_stars(links: DataFrame) -> bool:
    """Whether some a of distinct links (a > b) has more than one b, or is a b too; else each b is the smallest node of its component."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 OR leaf = 1 AND centre = 1").agg(F.count("*")).first()[0] > 0
