"""Which moments of a recording to look at: equal shares of motion, even times, sharpest neighbour; bands and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardflow.operators.hold import hold
from boardflow.operators.scans import place_in, previous, running_sum

# Fixed values.
MOTION_SHARE = 0.75
STILL = 1e-6
REACH, REACH_SHARE = 0.2, 0.25
END_GUARD = 0.05
CELL_SHARE, LEAST_CELLS, LEAST_SIDE, REGION_PAD = 0.18, 0.02, 0.25, 0.006
BAND_PAD = 0.25
BATCHES, LEAST_BATCH, MOST_BATCH = 6, 8, 40
MOST_WAIT = 90.0
#: Where a refusal names a wait, in the order of trial, and what part of a second its number counts.
WAITS = [(r"retry-after ([\d.]+)", 1.0), (r"(?i)retry in ([\d.]+)\s*s", 1.0), (r"(?i)try again in ([\d.]+)s", 1.0), (r"(?i)try again in ([\d.]+)ms", 0.001)]
CHARACTERS_PER_TOKEN, IMAGE_TOKENS, TOKENS_PER_MINUTE, REQUESTS, STRIPS, LEAST_FRAMES = 2.3, 1100, 225_000, 6, 3, 24


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of numbers; null for empty ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) > 0, total / F.size(a))


def motion_total(df: DataFrame, by: str, t: str, value: str, change: Callable[[Column, Column], Column] = lambda now, last: F.abs(now - last), out: str = "motion") -> DataFrame:
    """The running sum of a change from sample to sample, 0 at the first; a change that is null counts as none.

    Long recordings are scanned in blocks.
    """
    rows = previous(df, [by], [t], value, "_past")
    rows = running_sum(rows, [by], [t], F.coalesce(change(F.col(value), F.col("_past")).cast("double"), F.lit(0.0)), out)
    return rows.drop("_past")


def cell_changes(frames: DataFrame, by: str, t: str, grid: str) -> DataFrame:
    """``by``, cell, change: for each cell of a grid the sum of its changes over time."""
    before = frames.withColumn("_b", F.lag(grid).over(Window.partitionBy(by).orderBy(t))).where("_b is not null")
    cells = before.select(by, F.posexplode(F.zip_with(grid, "_b", lambda x, y: F.abs(x - y))).alias("cell", "d"))
    return cells.groupBy(by, "cell").agg(F.sum("d").alias("change"))


def moving_region(changes: DataFrame, by: str, width: int, height: int) -> DataFrame:
    """Bounding box (x0, y0, x1, y1 as shares) of the cells that change much; recordings where it is too small have no row."""
    top = changes.groupBy(by).agg(F.max("change").alias("top"))
    hot = changes.join(top, by).where((F.col("top") > 0) & (F.col("change") >= CELL_SHARE * F.col("top")))
    x, y = F.col("cell") % width, F.expr(f"cell div {width}")
    box = hot.groupBy(by).agg(F.count("*").alias("n"), F.min(x).alias("a"), F.min(y).alias("b"), F.max(x).alias("c"), F.max(y).alias("d"))
    sides = ((F.col("c") - F.col("a") + 1) / width >= LEAST_SIDE) & ((F.col("d") - F.col("b") + 1) / height >= LEAST_SIDE)
    low, high = lambda c: F.greatest(F.lit(0.0), c - REGION_PAD), lambda c: F.least(F.lit(1.0), c + REGION_PAD)
    box = box.where((F.col("n") >= LEAST_CELLS * width * height) & sides)
    return box.select(by, low(F.col("a") / width).alias("x0"), low(F.col("b") / height).alias("y0"), high((F.col("c") + 1) / width).alias("x1"), high((F.col("d") + 1) / height).alias("y1"))


def equal_motion_picks(df: DataFrame, by: str, t: str, motion: str, picks: int) -> DataFrame:
    """``by``, t: the first moment, and after each pick the first one at which the motion has grown by one more share; ``picks`` at most.

    ``motion`` is a running total. Of equal totals only the earliest moment can
    be picked, so totals stand for moments. Each total's next pick is found in
    its share of the recording, or is the first total of a later share. Picks
    are then followed by doubling: after round k the next 2^k of them are known.
    A recording that hardly moves gives its first moment.
    """
    if picks < 1:
        return df.select(by, t).limit(0)
    rows = df.select(F.col(by).alias("by"), F.col(t).alias("t"), F.col(motion).cast("double").alias("m"))
    ends = rows.groupBy("by").agg(F.min("m").alias("begin"), F.max("m").alias("end"))
    ends = ends.select("by", "begin", F.when(F.col("end") > STILL, F.col("end") / picks).alias("gap"))
    values = hold(rows.groupBy("by", "m").agg(F.min("t").alias("t")))
    moving = values.join(ends.where("gap is not null"), "by")
    wants = moving.select("by", F.col("m").alias("source"), (F.col("m") + F.col("gap")).alias("v"), F.floor((F.col("m") + F.col("gap")) / F.col("gap")).alias("share"))
    both = moving.select("by", F.lit(None).cast("double").alias("source"), F.col("m").alias("v"), F.floor(F.col("m") / F.col("gap")).alias("share")).unionByName(wants)
    total = F.when(F.col("source").isNull(), F.col("v"))
    falling = Window.partitionBy("by", "share").orderBy(F.desc("v"), F.col("source").asc_nulls_first())
    met = both.withColumn("there", F.last(total, True).over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("source is not null")
    # One row for each of about ``picks`` shares of a recording.
    later = Window.partitionBy("by").orderBy("share").rowsBetween(1, Window.unboundedFollowing)
    firsts = both.groupBy("by", "share").agg(F.min(total).alias("low")).select("by", "share", F.first("low", True).over(later).alias("then"))
    jump = met.join(firsts, ["by", "share"]).select("by", F.col("source").alias("m"), F.coalesce("there", "then").alias("next")).where("next is not null")
    jump = hold(jump)
    reached = hold(ends.select("by", F.col("begin").alias("m"), F.lit(0).alias("step")))
    size = 1
    while size < picks:
        ahead = reached.join(jump, ["by", "m"]).select("by", F.col("next").alias("m"), (F.col("step") + size).alias("step"))
        reached = hold(reached.unionByName(ahead.where(F.col("step") < picks)))
        size *= 2
        if size < picks:
            jump = hold(jump.join(jump.select("by", F.col("m").alias("next"), F.col("next").alias("far")), ["by", "next"]).select("by", "m", F.col("far").alias("next")))
    return reached.join(values, ["by", "m"]).select(F.col("by").alias(by), F.col("t").alias(t))


def even_time_picks(df: DataFrame, by: str, t: str, picks: int) -> DataFrame:
    """``by``, k, t: for each of ``picks`` even times the nearest sample, the earlier of two.

    Wanted times and samples are merged in one sorted window, so a sample is
    not compared with every wanted time.
    """
    rows = df.select(by, F.col(t).cast("double").alias("at"))
    span = rows.groupBy(by).agg(F.max("at").alias("dur"))
    wants = span.select(by, F.explode(F.sequence(F.lit(0), F.lit(picks - 1))).alias("k"), "dur").select(by, "k", ((F.col("k") + 0.5) / picks * F.col("dur")).alias("at"))
    both = rows.withColumn("k", F.lit(None).cast("int")).unionByName(wants)
    order = Window.partitionBy(by).orderBy("at", F.col("k").asc_nulls_first())
    sample = F.when(F.col("k").isNull(), F.col("at"))
    both = both.withColumn("low", F.last(sample, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("high", F.first(sample, True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("k is not null")
    nearer = F.when(F.col("low").isNull() | (F.col("high") - F.col("at") < F.col("at") - F.col("low")), F.col("high")).otherwise(F.col("low"))
    return both.select(by, "k", nearer.alias(t))


def picks_of(df: DataFrame, by: str, t: str, motion: str, budget: int) -> DataFrame:
    """All moments for a budget: three quarters by motion, the rest by time, and the last sample."""
    by_motion = round(budget * MOTION_SHARE)
    out = equal_motion_picks(df, by, t, motion, by_motion).select(by, F.col(t).cast("double").alias(t))
    if budget > by_motion:
        out = out.unionByName(even_time_picks(df, by, t, budget - by_motion).select(by, t))
    last = df.groupBy(by).agg(F.max(F.col(t).cast("double")).alias(t))
    return out.unionByName(last).distinct()


def neighbour_reach(df: DataFrame, by: str, t: str, out: str = "reach") -> DataFrame:
    """How far a pick may move: a quarter of the nearer gap, a fifth of a second at most."""
    window = Window.partitionBy(by).orderBy(t)
    gap = F.least(F.col(t) - F.lag(t).over(window), F.lead(t).over(window) - F.col(t))  # nulls are skipped
    return df.withColumn(out, F.least(F.lit(REACH), REACH_SHARE * gap))


def candidate_times(picks: DataFrame, by: str, t: str, duration: float) -> DataFrame:
    """``by``, t, k, at: a pick, and as far before and after it as it may move, inside the recording."""
    out = neighbour_reach(picks, by, t).select(by, t, "reach", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("k"))
    return out.withColumn("at", F.col(t) + F.col("k") * F.col("reach")).where((F.col("at") >= 0) & (F.col("at") <= duration - END_GUARD)).drop("reach")


def sharpest(candidates: DataFrame, keys: list[str], score: str, order: str, value: str) -> DataFrame:
    """The value with the largest score of each group, the first of several."""
    return candidates.groupBy(*keys).agg(F.max_by(value, F.struct(score, -F.col(order))).alias(value), F.max(score).alias(score))


def overlapping_bands(low: Column, high: Column, bands: int = 3) -> Column:
    """Equal bands of a span, each with a quarter of itself added on both sides, within the span: array of (band, low, high)."""
    size = (high - low) / bands

    def band(k: Column) -> Column:
        return F.struct(
            k.alias("band"),
            F.greatest(low, low + (k - BAND_PAD) * size).alias("low"),
            F.least(high, low + (k + 1 + BAND_PAD) * size).alias("high"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)


def batch_size(n: int) -> int:
    return min(MOST_BATCH, max(LEAST_BATCH, -(-n // BATCHES)))


def batched(df: DataFrame, by: str, order: list[Column | str], out: str = "batch") -> DataFrame:
    """Each list's rows in order, in runs of a size that its length decides. Long lists are numbered in blocks."""
    size = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")).select("_by", F.least(F.lit(MOST_BATCH), F.greatest(F.lit(LEAST_BATCH), F.ceil(F.col("_n") / BATCHES))).alias("_size"))
    rows = place_in(df, [by], order, "_nth")
    return rows.join(size, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, F.expr("(_nth - 1) div _size")).drop("_nth", "_size", "_by")


def frame_budget(prompt_characters: Column, frames: Column) -> Column:
    """What a run can afford, as struct (moments, images): moments wanted, and their images, after each request's prompt is paid for."""
    prompt = F.ceil(prompt_characters / CHARACTERS_PER_TOKEN)
    images = F.floor((TOKENS_PER_MINUTE - REQUESTS * (prompt + IMAGE_TOKENS)) / IMAGE_TOKENS)
    moments = F.greatest(F.lit(LEAST_FRAMES).cast("long"), F.least(frames.cast("long"), F.floor(images / STRIPS)))
    return F.struct(moments.alias("moments"), (moments * STRIPS).alias("images"))


def rolling_sum(df: DataFrame, by: str, t: str, value: str, seconds: int = 60, out: str = "used") -> DataFrame:
    """Sum of a value over the last seconds, this row included.

    A list is cut in spans of as many seconds; a row is seen in its own span and,
    as what came before, in the next one. So no task gets a whole list.
    """
    span = seconds * 1_000_000
    rows = df.withColumn("_t", F.unix_micros(F.col(t).cast("timestamp"))).withColumn("_span", F.floor(F.col("_t") / span))
    seen = rows.withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_span", F.col("_span") + F.col("_ahead"))
    window = Window.partitionBy(by, "_span").orderBy("_t").rangeBetween(-span, Window.currentRow)
    return seen.withColumn(out, F.sum(value).over(window)).where("_ahead = 0").drop("_t", "_span", "_ahead")


def wait_seconds(message: Column) -> Column:
    """Whole seconds that a refusal asks to wait, rounded up, 90 at most; null if it names none."""
    asked = F.lit(None).cast("double")
    for pattern, share in reversed(WAITS):
        found = F.regexp_extract(message, pattern, 1)
        asked = F.when(found != "", F.ceil(found.try_cast("double") * share).cast("double")).otherwise(asked)
    return F.when(asked.isNotNull(), F.least(F.lit(MOST_WAIT), asked))
