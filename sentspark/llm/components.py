"""Connected components of links between 64-bit nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch
from .tables import landed

#: Rounds grow with the logarithm of the node count; this only stops a defect.
MOST_ROUNDS = 100


def _towards_least(pairs: DataFrame) -> DataFrame:
    """``u, v`` -> ``u, v, m`` with ``m`` the least of ``u`` and its ``v``.

    The least is found by partial aggregation and joined back; a hub's rows
    are never one group of one task (a skewed join side is split)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links -> ``node, root``: every linked node and the least node it reaches.

    Large star: each node's greater neighbours are linked to the least one
    around it.  Small star: a node and its lesser neighbours are linked to
    their least.  Neither takes a component apart, and they settle in stars.
    Null nodes link nothing; no links give no rows.
    """
    links, path = landed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .where("u > v").distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _towards_least(large)
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        before = path
        links, path = landed(links, "stars")
        drop_scratch(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")
