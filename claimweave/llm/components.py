"""Connected components of a link table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.session import discard, store


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of it and its neighbours."""
    around = both_ways(links)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(links: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (its least node) for every node with a link; links: a, b of one orderable type.

    Rounds end when the links stay as they are: then each node is tied to its least reachable one.
    Each round is written to the shared folder, so none is computed twice. Loops and repeated
    links are dropped; no links give no rows.
    """
    spark = links.sparkSession
    now = store(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = now.df.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if state == before or state[0] == 0:
            break
        before = state
        new = store(small_star(large_star(now.df).distinct()).distinct(), "links")
        discard(spark, now.path)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
