"""Connected components of a link table by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014) rewire each node to the smallest node it sees until the links are stars.
Links stay distributed, each round is written to the shared folder, and only the number
and checksum of the links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit.llm.common import discard, staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "c")
    joined = both.where("b > a").join(least, F.col("a") == F.col("c"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least.withColumnRenamed("a", "c"), F.col("a") == F.col("c"))
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node that has a link; root is the smallest node it reaches."""
    a, b = F.col(left), F.col(right)
    now = staged(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == mark or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(seen)
        before, now = now, staged(_small_star(_large_star(now)), "links")
        discard(before)
