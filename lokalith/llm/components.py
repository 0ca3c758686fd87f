"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial aggregate and an equi-join; nothing reaches the driver but one checksum row a round.
Each round's edges are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import materialise


def _star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a")
    return small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of one integer type, in any direction and with repeats -> ``(node, root)``.

    ``root`` is the smallest node reachable; roots themselves are not listed. Self-links are ignored. An
    empty table gives an empty result.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, edges = now, materialise(_star(edges), "links")
