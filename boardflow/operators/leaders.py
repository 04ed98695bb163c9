"""Greedy leaders, in order of arrival, as rounds of joins.

A row joins the first earlier leader that it resembles, or else leads: the
leaders are the first independent set, in order of arrival, of the graph of
similar rows. The first row of a group leads in any case; all rows are compared
with it at once, so a group of one crowd never meets itself. Then rows are taken in blocks, each many times as long as all before
it. A block's graph is worked out by itself, and its leaders take their
followers out of all that comes later, so that a large crowd of similar rows is
gone before its pairs could meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.functions.similarity import similarity
from boardflow.operators.alike import alike_pairs
from boardflow.operators.hold import hold, meet, release

GROWTH, CUTS = 32, 9  # a block and all before it are 32 times as long as those before


def blocks(items: DataFrame, on: list[str], seq: str, first: int) -> DataFrame:
    """``items`` with ``level``: of each group the first rows by ``seq``, ``first`` of them at most, are level 0, the others of the first ``GROWTH`` times as many level 1, and so on.

    Cuts are approximate percentiles; where exactly they lie doesn't matter.
    """
    shares = [float(GROWTH) ** -j for j in range(CUTS)]
    cuts = items.groupBy(*on).agg(F.count("*").alias("_n"), F.percentile_approx(seq, shares, 1000).alias("_cuts"))
    last = F.greatest(F.lit(0), F.least(F.lit(CUTS - 1), F.ceil(F.log(float(GROWTH), F.col("_n") / first)))).cast("int")
    within = F.size(F.filter(F.slice("_cuts", F.lit(2), F.col("_last")), lambda c: F.col(seq) <= c))
    return meet(items, cuts.withColumn("_last", last), on).withColumn("level", F.col("_last") - within).drop("_n", "_cuts", "_last")


def followers(edges: DataFrame, on: list[str]) -> DataFrame:
    """``on``, b: the rows that aren't leaders; ``edges`` has ``on``, a, b with a before b.

    A row without an earlier neighbour leads and its later neighbours follow;
    both leave, which frees others. As many rounds as the longest chain of rows
    that each wait for the one before.
    """
    found, left = [], edges
    while not left.isEmpty():
        leads = meet(left.select(*on, "a"), left.select(*on, F.col("b").alias("a")), [*on, "a"], "left_anti").distinct()
        gone = hold(meet(left, leads, [*on, "a"]).select(*on, "b").distinct())
        found.append(gone)
        rest = meet(meet(left, leads, [*on, "a"], "left_anti"), gone, [*on, "b"], "left_anti")
        rest = hold(meet(rest, gone.withColumnRenamed("b", "a"), [*on, "a"], "left_anti").select(*on, "a", "b"))
        if left is not edges:
            release(left)
        left = rest
    out = edges.select(*on, "b").limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def first_leaders(items: DataFrame, on: list[str], key: str, seq: str, least: float, first: int = 256) -> DataFrame:
    """``on``, ``seq``, leader (the leader's ``seq``) of every row; ``seq`` is unique in a group.

    Rows resemble each other if their keys are at least ``least`` alike (half or
    more); rows with an empty key resemble none and lead.
    """
    rows = items.select(*on, F.col(key).alias("key"), F.col(seq).alias("seq"))
    out = rows.where("key = ''").select(*on, "seq", F.col("seq").alias("leader"))
    rows = rows.where("key != ''")
    heads = rows.groupBy(*on).agg(F.min_by("key", "seq").alias("_head"), F.min("seq").alias("_first"))
    rows = hold(meet(rows, heads, on).select(*on, "key", "seq", F.when(similarity(F.col("key"), F.col("_head")) >= least, F.col("_first")).alias("leader")))
    out = out.unionByName(rows.where("leader is not null").drop("key"))
    todo = hold(blocks(rows.where("leader is null").drop("leader"), on, "seq", first))
    top, sizes = todo.agg(F.max("level"), F.collect_set(F.char_length("key"))).first()
    sizes = set(sizes)
    for level in range(-1 if top is None else top + 1):
        block = todo.where(F.col("level") == level).drop("level")
        theirs = block.select(*on, F.col("key").alias("form_key"), F.col("seq").alias("other"))
        edges = hold(alike_pairs(block, theirs, least, tuple(on), sizes).where("other < seq").select(*on, F.col("other").alias("a"), F.col("seq").alias("b")))
        follow = followers(edges, on).withColumnRenamed("b", "seq")
        leads = hold(meet(block, follow, [*on, "seq"], "left_anti"))
        out = out.unionByName(leads.select(*on, "seq", F.col("seq").alias("leader")))
        named = leads.select(*on, F.col("seq").alias("a"))
        out = out.unionByName(meet(edges, named, [*on, "a"]).groupBy(*on, F.col("b").alias("seq")).agg(F.min("a").alias("leader")))
        if level < top:
            later = todo.where(F.col("level") > level)
            heads = leads.select(*on, F.col("key").alias("form_key"), F.col("seq").alias("leader"))
            taken = hold(alike_pairs(later.drop("level"), heads, least, tuple(on), sizes).groupBy(*on, "seq").agg(F.min("leader").alias("leader")))
            out = out.unionByName(taken)
            todo = hold(meet(later, taken, [*on, "seq"], "left_anti"))
    return out.withColumnRenamed("seq", seq)
