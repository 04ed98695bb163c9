"""Many sightings of a ranked list to one row for each place.

Modes are first-to-peak: the most frequent value, and of several the one whose
count got there first. As counts peak with a value's last sighting, that is the
largest (count, -last sighting), which an aggregate finds without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardflow.functions.similarity import ORPHAN, similarity
from boardflow.functions.text import fold, symbols
from boardflow.operators.hold import hold, meet
from boardflow.operators.leaders import first_leaders

LATER = 1 << 60  # attached sightings count after a group's own
BLANK_RANK = 9999
TALLIED = ["board_id", "rank", "points", "name", "plain", "roster_name"]


def label_of() -> Column:
    """The plain name, or else the name."""
    return F.coalesce(F.nullif(F.col("plain"), F.lit("")), F.col("name"))


def peak_mode(df: DataFrame, keys: list[str], value: str, seq: str, out: str = "mode") -> DataFrame:
    """Of each group the first-to-peak mode of a column; ``seq`` orders the rows and is unique in a group."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.max(seq).alias("last"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", _back(F.col("last"), df.schema[seq].dataType.typeName()))).alias(out))


def _back(c: Column, kind: str) -> Column:
    return -F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else -c


def ordered_distinct(df: DataFrame, keys: list[str], value: str, seq: str, out: str = "found") -> DataFrame:
    """Of each group the distinct values in order of first appearance; only distinct values are gathered."""
    first = df.groupBy(*keys, value).agg(F.min(seq).alias("first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value]).alias(out))


def tally(sightings: DataFrame) -> DataFrame:
    """Equal sightings of a board as one row: their number ``n`` and the ``first`` and ``last`` of their ``seq``.

    It is all that consolidation needs to know of them. As it is one aggregate,
    it also works on a stream.
    """
    rows = sightings.withColumn("rank", F.when(F.col("rank") > 0, F.col("rank")))
    return rows.groupBy(*TALLIED).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def _summary(members: DataFrame) -> DataFrame:
    """members: board_id, gid, points, name, plain, roster_name, rank, n, first, last."""
    alike = members.withColumn("plain", label_of()).groupBy("board_id", "gid", "points", "name", "plain", "roster_name").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.min("first").alias("first"))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in ("points", "name", "plain", "roster_name")])
    values = alike.select("board_id", "gid", "n", "last", "first", F.inline(fields)).where("field != 'roster_name' or value != ''")
    counts = values.groupBy("board_id", "gid", "field", "value").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.min("first").alias("first"))

    def mode(field: str) -> Column:
        return F.max_by("value", F.when(F.col("field") == field, F.struct("n", -F.col("last"))))

    def distinct(field: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == field) & (F.col("value") != ""), F.struct("first", "value")))), lambda x: x["value"])

    modes = counts.groupBy("board_id", "gid").agg(
        mode("points").cast("double").alias("points"),
        mode("name").alias("name"),
        mode("plain").alias("plain"),
        distinct("name").alias("obs"),
        distinct("roster_name").alias("claims"),
        F.coalesce(mode("roster_name"), F.lit("")).alias("pick_"),
        F.sum(F.when(F.col("field") == "points", F.col("n"))).alias("seen"),
    )
    heads = members.groupBy("board_id", "gid").agg(F.max("rank").alias("rank"), F.min("first").alias("group_pos"))
    return meet(modes, heads, ["board_id", "gid"]).withColumn("seenRank", F.col("rank"))


def consolidate(sightings: DataFrame) -> DataFrame:
    """One row for each place of a board: points, name, plain, obs, claims, pick_, rank, seenRank, seen, group_pos.

    Sightings with a rank are grouped by it. One without joins the first group
    of its very score whose first sighting has a similar name, or else earlier
    ones like itself. Names without letters are alike only if their symbols are.
    Sightings that show the same name for the same score go the same way, so
    only distinct names are compared.
    """
    return consolidate_tallies(tally(sightings))


def consolidate_tallies(tallies: DataFrame) -> DataFrame:
    """``consolidate`` of sightings that ``tally`` has put together already."""
    rows = hold(tallies.select(*TALLIED, "n", "first", "last"))
    ranked = rows.where("rank is not null").withColumn("gid", F.concat(F.lit("r"), F.col("rank")))
    keyed = lambda df: df.withColumn("label", label_of()).withColumn("key", fold(F.col("label"))).withColumn("shown", symbols(F.col("label"))).drop("label")
    orphans = keyed(rows.where("rank is null"))

    scores = ranked.groupBy("board_id", "gid", "points").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    modes = scores.groupBy("board_id", "gid").agg(F.max_by("points", F.struct("n", -F.col("last"))).alias("g_points"))
    firsts = ranked.groupBy("board_id", "gid").agg(F.min_by(F.struct("plain", "name"), "first").alias("f"), F.min("first").alias("g_pos")).select("board_id", "gid", "g_pos", "f.plain", "f.name")
    firsts = keyed(firsts).select("board_id", "gid", "g_pos", F.col("key").alias("g_key"), F.col("shown").alias("g_shown"))
    groups = meet(modes, firsts, ["board_id", "gid"])
    alike = F.when((F.col("key") == "") & (F.col("g_key") == ""), F.col("shown") == F.col("g_shown")).otherwise(similarity(F.col("key"), F.col("g_key")) >= ORPHAN)
    same = ["board_id", "points", "key", "shown"]
    distinct = hold(orphans.groupBy(*same).agg(F.min("first").alias("seq")))
    near = meet(distinct, groups.withColumnRenamed("g_points", "points"), ["board_id", "points"]).where(alike)
    attached = near.groupBy(*same).agg(F.min_by("gid", "g_pos").alias("gid"))
    rest = meet(distinct, attached, same, "left_anti")
    rest = hold(rest.select(*same, "seq"))
    led = first_leaders(rest, ["board_id", "points"], "key", "seq", ORPHAN)
    led = meet(rest, led, ["board_id", "points", "seq"]).select(*same, F.concat(F.lit("o"), "leader").alias("gid"))
    placed = meet(orphans, attached.unionByName(led), same).withColumns({c: F.col(c) + LATER for c in ("first", "last")})
    members = hold(ranked.unionByName(placed.select(ranked.columns)))
    out = _summary(members)
    return out.withColumn("group_pos", F.col("group_pos") % LATER + F.when(F.col("rank").isNull(), LATER).otherwise(0))


def board_order(board: str = "board_id") -> Window:
    """Best score first, then the printed rank, blank ones last, then first appearance."""
    return Window.partitionBy(board).orderBy(F.desc("points"), F.coalesce(F.col("seenRank"), F.lit(BLANK_RANK)), "group_pos")
