"""Upper median and the filter of scores that belong to another list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardflow.operators.hold import hold

# Fixed values.
LEAST_SCORES = 8
TIMES_MEDIAN = 8
CELLS = 64  # that a group's values are cut into in a round


def upper_median(df: DataFrame, by: str, value: str, few: int = 4096, times: str | None = None) -> DataFrame:
    """``by``, n, median: element ``n div 2`` (from 0) of the sorted positive values of each group.

    With ``times`` a row stands for as many equal ones as that column says.

    Exact, without bringing a group together: a group's values are cut at
    approximate percentiles, the cells are counted, and only the cell that holds
    the element is looked at again, until it has ``few`` values or a single one.
    So the only windows are over cells and over ``few`` values. One number of a
    round comes to the driver.
    """
    rows = df.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v"), (F.col(times) if times else F.lit(1)).cast("long").alias("k")).where("v > 0 AND by IS NOT NULL")
    rows = rows.groupBy("by", "v").agg(F.sum("k").alias("k"))  # of equal values, however many, no cut could part them from others
    state = rows.groupBy("by").agg(F.sum("k").alias("n"), F.sum("k").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = hold(state.withColumn("below", F.lit(0).cast("long")))
    inside = lambda: rows.join(state, "by").where("v >= low AND v <= high")
    while (state.where("low < high").agg(F.max("size")).first()[0] or 0) > few:
        wide = state.where(f"low < high AND size > {few}")
        rows = hold(rows.join(wide.select("by", "low", "high"), "by", "left").where("low IS NULL OR v >= low AND v <= high").select("by", "v", "k"))
        cuts = rows.join(wide.select("by"), "by").groupBy("by").agg(F.percentile_approx("v", [k / CELLS for k in range(1, CELLS)], 1000).alias("cuts"))
        cell = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        cells = rows.join(cuts, "by").groupBy("by", cell.alias("cell")).agg(F.sum("k").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("size").over(Window.partitionBy("by").orderBy("cell"))  # of at most CELLS rows
        cells = cells.withColumn("before", upto - F.col("size")).join(wide.select("by", "n", "below"), "by")
        cells = cells.withColumn("below", F.col("below") + F.col("before")).where("below <= n div 2 AND n div 2 < below + size")
        state = hold(state.join(wide.select("by"), "by", "left_anti").unionByName(cells.select("by", "n", "size", "low", "high", "below")))
    values = inside().where("low < high").groupBy("by", "n", "below", "v").agg(F.sum("k").alias("k"))
    values = values.withColumn("end", F.col("below") + F.sum("k").over(Window.partitionBy("by").orderBy("v")))
    found = values.where("end > n div 2").groupBy("by").agg(F.first("n").alias("n"), F.min("v").alias("median"))
    return found.unionByName(state.where("low = high").select("by", "n", F.col("low").alias("median"))).withColumnRenamed("by", by)


def drop_foreign_rows(df: DataFrame, by: str = "board_id", value: str = "points", rank: str | None = "rank", times: str | None = None) -> DataFrame:
    """Leave out scores above eight upper medians; scores of zero or less stay only with a rank.

    A group with under eight positive scores stays as it is. With ``times`` a row
    stands for as many equal ones as that column says.
    """
    names = df.columns
    medians = upper_median(df, by, value, times=times).where(F.col("n") >= LEAST_SCORES).select(F.col(by).alias("m_by"), "median")
    rows = df.join(medians, F.col(by) == F.col("m_by"), "left")
    ranked = F.coalesce(F.col(rank) > 0, F.lit(False)) if rank else F.lit(False)
    keep = F.when(F.col(value) > 0, F.col(value) <= TIMES_MEDIAN * F.col("median")).otherwise(ranked)
    return rows.where(F.col("median").isNull() | keep).select(*names)
