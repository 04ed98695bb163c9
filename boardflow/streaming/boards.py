"""Boards kept up to date while readings arrive.

What is kept of a board is a number and two positions for each distinct reading
(``tally``). A micro-batch's tallies are added to the stored ones of their
boards, and those boards are consolidated anew. So a batch costs what its boards
have of distinct readings, however often each was seen before, and no executor
keeps readings in memory between batches.

Tallies are stored in ``buckets`` of boards, a new generation of a bucket in
each batch that touches it. A batch that runs twice reads the same generation
as before and replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boardflow.operators.clean import drop_foreign_rows
from boardflow.operators.consolidate import TALLIED, consolidate_tallies, tally
from boardflow.operators.hold import hold, release, remove

BUCKETS = 64


def _generations(spark: SparkSession, store: str) -> dict[int, list[tuple[int, str]]]:
    """Of each bucket its generations with their folders, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/batch=*/bucket=*")
    found: dict[int, list[tuple[int, str]]] = {}
    for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
        path = status.getPath()
        number = lambda p: int(p.getName().split("=")[1])
        found.setdefault(number(path), []).append((number(path.getParent()), path.toString()))
    return {k: sorted(v) for k, v in found.items()}


def update_boards(tallies: DataFrame, batch_id: int, store: str, out: str, buckets: int = BUCKETS, added: bool = False) -> None:
    """``tallies``: those that changed in this batch, as they are after it; with ``added`` those of this batch alone, which count on top of the stored ones.

    Generations that two later batches don't need any more are deleted: when a
    batch runs, all before it are known to have ended.
    """
    spark = tallies.sparkSession
    changed = hold(tallies.withColumn("bucket", F.pmod(F.xxhash64("board_id"), F.lit(buckets)).cast("int")))
    touched = {r["bucket"] for r in changed.select("bucket").distinct().collect()}  # of ``buckets``
    before = {k: [g for g in v if g[0] < batch_id] for k, v in _generations(spark, store).items() if k in touched}
    newest = [v[-1][1] for v in before.values() if v]
    both = changed
    if newest:
        schema = changed.drop("bucket").schema
        both = both.unionByName(spark.read.schema(schema).parquet(*newest).withColumn("bucket", F.pmod(F.xxhash64("board_id"), F.lit(buckets)).cast("int")))
    # Numbers only grow, so of a reading's tallies that are as they are after a batch the largest is the newest.
    now = both.groupBy("bucket", *TALLIED).agg((F.sum("n") if added else F.max("n")).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    if touched:
        now.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")
        stored = spark.read.schema(now.schema).parquet(f"{store}/batch={batch_id}")
        mine = stored.join(changed.select("board_id").distinct(), "board_id", "left_semi")
        boards = consolidate_tallies(drop_foreign_rows(mine, times="n"))
        boards.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("board_id").parquet(out)
    for path in (g[1] for v in before.values() for g in v[:-1]):  # a few for each bucket
        remove(spark, path)
    release(changed)


def keep_boards(sightings: DataFrame, store: str, out: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Start the stream; ``sightings`` are columns of ``parse_replies``, ``trigger`` goes to Spark's trigger.

    ``buckets`` has to stay the same for a ``store``.
    """
    spark = sightings.sparkSession

    def take(batch: DataFrame, i: int) -> None:
        # A stream's own session plans without adaptive execution, so its rows are taken over by the one that it was started from.
        rows = hold(batch)
        update_boards(tally(spark.read.schema(rows.schema).parquet(rows.held_at)), i, store, out, buckets, added=True)
        release(rows)

    return sightings.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(take).start()


def rolling_totals(events: DataFrame, t: str, by: str, value: str, late: str = "5 minutes", width: str = "1 minute", slide: str = "10 seconds") -> DataFrame:
    """Sums of the last ``width`` at every ``slide``, from a stream or a table; rows later than ``late`` are too late."""
    held = events.withWatermark(t, late)
    out = held.groupBy(F.window(t, width, slide).alias("w"), by).agg(F.sum(value).alias("used"), F.count("*").alias("rows"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "used", "rows")
