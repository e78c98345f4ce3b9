"""Connected components of a link table, by alternating star contraction.

Every round is two groupings and joins over the links, however large a component is;
no component is gathered in one place. A round that changes nothing ends it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """For each node ``u`` of (u, v): its pairs and the least node among u and all v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    far = _with_least(both).where("v > u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` with u > v."""
    near = _with_least(links)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = near.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every linked node but the roots, the least nodes of their components."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    stars = stored(pairs.distinct(), "links")
    before = None
    while True:
        stars = stored(_small_star(_large_star(stars).where("u <> v")), "links")
        mark = stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
