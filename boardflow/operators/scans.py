"""Running values of long lists: ranges of a list are summed up by themselves, then carried in.

A window by list would bring a whole list to one task. Here rows are dealt by
range of (list, order), so a long list spans many blocks; windows are by list
and block, and one row of each list and block is carried on to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardflow.operators.hold import hold

Order = list[Column | str]


def in_blocks(df: DataFrame, by: list[str], order: Order) -> DataFrame:
    """``df`` with ``_block``: rows of equal ``by`` and order are in one block, and blocks follow each other in that order."""
    return hold(df.repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()))


def inside(by: list[str], order: Order) -> Window:
    return Window.partitionBy("_block", *by).orderBy(*order)


def upto(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(by: list[str]) -> Window:
    """All earlier blocks of a list; over rows that ``summed`` gave."""
    return Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def summed(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """One row for each list and block."""
    return rows.groupBy("_block", *by).agg(*[c.alias(n) for n, c in values.items()])


def carried(rows: DataFrame, sums: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the named columns of their block's sums; null lists are lists too."""
    other = sums.select(F.col("_block").alias("_of"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *names)
    on = F.col("_block") == F.col("_of")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(other, on).drop("_of", *[f"_by{i}" for i in range(len(by))])


def running_sum(df: DataFrame, by: list[str], order: Order, value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over all rows of the list so far, this one included."""
    rows = in_blocks(df.withColumn("_v", value), by, order)
    sums = summed(rows, by, _sum=F.sum("_v"))
    sums = sums.withColumn("_before", F.sum("_sum").over(before(by)))
    own = F.sum("_v").over(upto(inside(by, order)))
    return carried(rows.withColumn("_own", own), sums, by, ["_before"]).withColumn(out, F.when(F.col("_before").isNull(), F.col("_own")).otherwise(F.col("_before") + F.coalesce("_own", F.lit(0)))).drop("_v", "_own", "_before", "_block")


def place_in(df: DataFrame, by: list[str], order: Order, out: str) -> DataFrame:
    """The place of a row in its list, from 1."""
    rows = in_blocks(df, by, order)
    sums = summed(rows, by, _rows=F.count("*"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_rows").over(before(by)), F.lit(0)))
    own = F.row_number().over(inside(by, order))
    return carried(rows.withColumn("_own", own), sums, by, ["_before"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_block")


def previous(df: DataFrame, by: list[str], order: Order, value: str, out: str) -> DataFrame:
    """The value of the row before in the list; null for the first."""
    rows = in_blocks(df, by, order)
    window = inside(by, order)
    first = F.row_number().over(window) == 1
    rows = rows.withColumns({"_first": first, "_lag": F.lag(value).over(window), "_last": F.lead(F.lit(1)).over(window).isNull()})
    ends = summed(rows, by, _end=F.max(F.when(F.col("_last"), F.struct(F.col(value).alias("v")))))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*by).orderBy("_block")))
    return carried(rows, ends, by, ["_before"]).withColumn(out, F.when(F.col("_first"), F.col("_before.v")).otherwise(F.col("_lag"))).drop("_first", "_lag", "_last", "_before", "_block")


def filled_ranks(df: DataFrame, by: list[str], order: Order, rank: str, out: str) -> DataFrame:
    """Printed ranks (over 0) stay; another row gets one more than the running maximum so far.

    Closed form: with U the rows without a rank so far, such a row has U plus
    the largest of 0 and rank - U of the rows with one so far.
    """
    rows = in_blocks(df, by, order)
    window = upto(inside(by, order))
    has = F.coalesce(F.col(rank) > 0, F.lit(False))
    rows = rows.withColumn("_blank", F.sum(F.when(has, 0).otherwise(1)).over(window))
    over = F.when(has, F.col(rank) - F.col("_blank"))
    rows = rows.withColumns({"_over": over, "_lead": F.max(over).over(window)})
    sums = summed(rows, by, _blanks=F.max("_blank"), _most=F.max("_over"))
    sums = sums.withColumn("_blanks_before", F.coalesce(F.sum("_blanks").over(before(by)), F.lit(0)))
    sums = sums.withColumn("_lead_before", F.max(F.col("_most") - F.col("_blanks_before")).over(before(by)))
    rows = carried(rows, sums, by, ["_blanks_before", "_lead_before"])
    blank = F.col("_blank") + F.col("_blanks_before")
    lead = F.greatest(F.lit(0), F.col("_lead") - F.col("_blanks_before"), "_lead_before")  # nulls are skipped
    filled = F.when(has, F.col(rank)).otherwise(blank + lead)
    return rows.withColumn(out, filled.cast("long")).drop("_block", "_blank", "_over", "_lead", "_blanks_before", "_lead_before")
