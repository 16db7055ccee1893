"""Connected components of a link table by alternating large and small stars.

Every step is a DataFrame join; nothing is gathered on the driver but whether a round left a forest of stars. Each round is
a written table, so lost executors cost one round at most. The minimum of a vertex's neighbours is
combined before its shuffle; it is joined from a written table, so a vertex that many links share can be
split. The number of rounds grows with the logarithm of the longest chain, squared at worst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch


def _star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Both directions of the links with the least vertex near each ``u`` (itself included)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    least = scratch.save(least, name)
    return both.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every vertex of ``links`` (u, v; any order, repeats and loops allowed).

    The component is the smallest id reachable. Vertices without links are not returned. An empty table
    gives an empty result.
    """
    current = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = scratch.save(current, "links-0")
    step = 0
    while True:
        step += 1
        large = _star(current, scratch, f"least-{step}a").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.filter("u != v").distinct(), f"large-{step}")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), f"least-{step}b")
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u != v").union(least.select("k", "m")).distinct()
        small = scratch.save(small, f"links-{step}")
        scratch.drop(f"links-{step - 1}", f"least-{step}a", f"large-{step}", f"least-{step}b")
        # done if every vertex is a centre or has one link, to a centre
        ends = small.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(small.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not ends.filter("out > 1 or (out = 1 and into = 1)").take(1):
            return small.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                small.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        current = small
