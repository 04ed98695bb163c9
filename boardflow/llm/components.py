"""Connected components of links, by alternating large-star and small-star steps.

Every step is an aggregation (the least neighbour of each node) and a join that
Spark may split where a node has very many neighbours. Links are written to the
shared folder between rounds; only one number of a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` are (u, v) with u > v. Large: every larger neighbour of a node goes to its least one; small: every node and its smaller neighbours do."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # The larger neighbours of u are the rows whose v is u.
        out = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_star(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or the other way round."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count() == 0


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` has columns a, b (long, not null). Return node, component (its least node), for every linked node.

    Links in any direction, repeated or from a node to itself are fine; a node
    with none but to itself isn't returned. No links give no rows.
    """
    now = scratch.keep(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _is_star(now):
        old = now
        now = scratch.keep(_star(_star(now, large=True), large=False), "links")
        scratch.drop(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
