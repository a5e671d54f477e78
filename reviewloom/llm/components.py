"""Connected components of a link table, by alternating star contraction (Kiveris et al., 2014).

Every step is a grouped minimum with map-side combine and a join back, so neither a hub with
very many links nor a long chain is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewloom.llm.store import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node that has a link; component is the smallest node reachable.

    Links of a node with itself, with null, and repeated links are allowed and add nothing.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    stars = staged(ends.where("u <> v").distinct(), "links")
    state = None
    while True:
        before, state = state, stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state[0] == 0 or state == before:
            break
        stars = staged(_small_star(_large_star(stars)), "stars")
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
