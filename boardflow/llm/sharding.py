"""Sharding by proportional stratified interleaving, in DataFrame operations.

Rows are put in a seeded random order within their source. Row ``r`` of a
source with ``n`` rows gets the fraction ``(2r - 1) / 2n``; all rows sorted by
fraction interleave the sources in proportion, and equal cuts of that order
give shards that all carry the mixture and differ by one row at most.

No window ever holds a whole source: ranks are taken in cells of about
``cell_rows`` rows (ranges of the random key within a source, then ranges of
the fraction), and the cells' counts are summed up to give offsets. Only keys
are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, power_of_two, table

KEY_BITS = 60


def shuffle_key(ident: Column, seed: int, *more: Column) -> Column:
    """60 random-looking bits of an id, a seed and what else tells rows apart, so that rows of one id don't meet in one cell."""
    text = F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("null")), F.lit(f"{seed}"), *[c.cast("string") for c in more])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def assign_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 42,
    cell_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Return one row per input row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    * null text has size 1 (no bytes plus one) and the checksum of no bytes;
    * a null source is a stratum of its own;
    * null or repeated ids are rows like others: ties in the random key are
      ordered by id, checksum and size, so equal rows are interchangeable;
    * with fewer rows than shards some shards are empty; an empty table gives none;
    * ``law`` is ``rows``, so ``grown_shard`` is null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    total = docs.count()
    bits = power_of_two(total / cell_rows)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("stratum"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shuffle_key(F.col("doc_id"), seed, F.crc32(body.cast("binary")), F.octet_length(body)).alias("key"),
    )
    rows = rows.withColumn("cell", F.shiftright("key", KEY_BITS - bits))
    in_source = Window.partitionBy("stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy("stratum", "cell")
        .agg(F.count("*").alias("rows"))
        .select(
            "stratum",
            "cell",
            F.coalesce(F.sum("rows").over(in_source), F.lit(0)).alias("before"),
            F.sum("rows").over(Window.partitionBy("stratum")).alias("of"),
        )
    )
    in_cell = Window.partitionBy("stratum", "cell").orderBy("key", "doc_id", "text_crc32", "size")
    rank = F.row_number().over(in_cell)
    ranked = rows.withColumn("rank", rank).join(cells, ["stratum", "cell"])
    share = (2 * (F.col("before") + F.col("rank")) - 1) / (2 * F.col("of")).cast("double")
    ranked = ranked.select("doc_id", "source", "stratum", "size", "text_crc32", "key", share.alias("share"))
    ranked = scratch.keep(ranked.withColumn("band", F.least(F.lit((1 << bits) - 1), F.floor(F.col("share") * (1 << bits)))), "ranked")
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # one row for each cell_rows rows
    bands = ranked.groupBy("band").agg(F.count("*").alias("rows")).select("band", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    in_band = Window.partitionBy("band").orderBy("share", "key", "stratum", "doc_id", "text_crc32", "size")
    at = ranked.withColumn("row", F.row_number().over(in_band)).join(bands, "band")
    # Row p of n, from 0, goes to shard ((p + 1) * shards - 1) div n, which begins at row (shard * n) div shards.
    at = at.withColumn("place", F.col("before") + F.col("row") - 1)
    at = at.withColumn("shard", F.expr(f"((place + 1) * {shards} - 1) div {max(1, total)}").cast("int"))
    return at.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - F.expr(f"(cast(shard as bigint) * {total}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_stratified_shards(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=16).drop("source")


#: One sort of all rows, and CRC-32 of whole texts bit by bit.
OP9_SQL = """
WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
b AS (SELECT text, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')[:-2], lambda h: ('0x' || h)::BIGINT) AS bytes FROM t),
k AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
  lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) AS text_crc32 FROM b),
s AS (SELECT doc_id, coalesce('1' || source, '0') AS stratum, strlen(k.text) AS bytes, text_crc32 FROM documents d JOIN k ON k.text = coalesce(d.text, '')),
m AS (SELECT *, ('0x' || md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), 42, text_crc32, bytes))[1:15])::BIGINT AS key FROM s),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, text_crc32, bytes) - 1) / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS share FROM m),
p AS (SELECT *, row_number() OVER (ORDER BY share, key, stratum, doc_id NULLS FIRST, text_crc32, bytes) - 1 AS place, count(*) OVER () AS n FROM f),
c AS (SELECT *, ((place + 1) * 16 - 1) // n AS shard FROM p)
SELECT doc_id, bytes + 1 AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, place - shard * n // 16 AS slot, NULL::INTEGER AS grown_shard FROM c
"""
