"""Running ranks, missing ranks, tallies and review counts, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardflow.operators.scans import filled_ranks


def fill_ranks(df: DataFrame, by: list[str], order: list[Column | str], rank: str, out: str = "place") -> DataFrame:
    """A printed rank (over 0) stays; another row gets one more than the running maximum so far. Long lists are scanned in blocks."""
    return filled_ranks(df, by, order, rank, out)


def missing_ranks(df: DataFrame, by: str, rank: str, at_once: int = 100_000) -> DataFrame:
    """``by``, top and hole: every integer from 1 to the largest rank of a group that isn't there.

    Each gap between neighbouring ranks is spelt out by itself, ``at_once`` holes
    at a time, so no row holds a group's whole range.
    """
    seen = df.where(F.col(rank) > 0).select(by, F.col(rank).cast("long").alias("at")).distinct()
    own = Window.partitionBy(by)
    gaps = seen.withColumn("before", F.coalesce(F.lag("at").over(own.orderBy("at")), F.lit(0))).withColumn("top", F.max("at").over(own)).where("at - before > 1")
    runs = gaps.select(by, "top", "at", F.explode(F.sequence(F.col("before") + 1, F.col("at") - 1, F.lit(at_once).cast("long"))).alias("low"))
    return runs.select(by, "top", F.explode(F.sequence("low", F.least(F.col("low") + at_once, F.col("at")) - 1)).alias("hole"))


def run_summary(df: DataFrame, readings: str, frames: str) -> DataFrame:
    """One row: how many readings, distinct frames and rows a run has; ``df`` has a row for each place, with the number of its readings."""
    return df.agg(F.coalesce(F.sum(readings), F.lit(0)).alias("readings"), F.countDistinct(frames).alias("frames"), F.count("*").alias("rows"))


def tally(df: DataFrame, by: str, group: str, position: str, allowed: list[str] | None = None) -> DataFrame:
    """The most frequent group of each list and its count; of several the one that appears first.

    With ``allowed``, a list whose most frequent group isn't in it offers ''.
    """
    counts = df.where(F.col(group).isNotNull() & (F.col(group) != "")).groupBy(by, group).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    best = F.max_by(F.struct(group, "n"), F.struct("n", -F.col("first")))
    top = counts.groupBy(by).agg(best.alias("b")).select(by, F.col(f"b.{group}").alias(group), "b.n")
    return top if allowed is None else top.withColumn(group, F.when(F.col(group).isin(allowed), F.col(group)).otherwise(""))


def row_state(dupe: Column, search: Column) -> Column:
    return F.when(dupe, "dupe").when(F.coalesce(search, F.lit("")) != "", "matched").otherwise("fresh")


def review_counts(df: DataFrame, by: str, state: str = "state") -> DataFrame:
    return df.groupBy(by).agg(*[F.count_if(F.col(state) == s).alias(n) for s, n in (("matched", "matched"), ("fresh", "fresh"), ("dupe", "dupes"))])
