"""Connected components of a stored list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches, itself included.

    Every step moves links towards the smallest neighbour, so their number never grows; the minimum of a node's
    neighbours is a combined aggregate and is joined back, so that a node with very many links is not
    gathered anywhere. The links are written after each pair of steps, which also cuts the lineage.
    """
    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select("b", "a"))
        else:  # from the larger end only
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def summary(e: DataFrame):
        h = F.xxhash64("a", "b")
        return e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()

    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = summary(now)
    while True:
        now = stored(step(step(now, True), False), "links")
        last, mark = mark, summary(now)
        if last == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
