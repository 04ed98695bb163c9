"""Line dedup by overlapping three-line windows, in DataFrame operations.

Every run of three consecutive lines is hashed (two 64-bit hashes). A window
that stands anywhere else earlier, in (doc_id, line) order, is a repeat, and
its three lines are covered. Covered lines go; the runs between them, found by
merging the sorted starts of the repeats, are joined again.

Counting happens with map-side partial aggregation, so a window that a third
of all documents share travels as one row per task. Only windows that do
repeat are joined back, and Spark may split that join's hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import pick, table

WINDOW = 3
LINES = r"split(coalesce(text, ''), '\n', -1)"  # SQL


def _lines(docs: DataFrame, **columns: str) -> DataFrame:
    return pick(docs, **columns).withColumn("mark", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Start of every later occurrence of a three-line window: doc_id, mark (hash of the text), starts (sorted)."""
    rows = _lines(docs, doc_id=id_col, text=text_col).withColumn("lines", F.expr(LINES)).where(F.size("lines") >= WINDOW)
    windows = rows.select(
        "doc_id",
        "mark",
        F.posexplode(
            F.expr(
                f"transform(sequence(0, size(lines) - {WINDOW}), i -> struct("
                "xxhash64(lines[i], lines[i + 1], lines[i + 2]) as a,"
                "xxhash64('second', lines[i], lines[i + 1], lines[i + 2]) as b))"
            )
        ).alias("line", "w"),
    ).select("w.a", "w.b", F.struct("doc_id", "mark", "line").alias("at"))
    first = windows.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last").drop("last")
    later = windows.join(first, ["a", "b"]).where("at != first")
    return later.groupBy("at.doc_id", "at.mark").agg(F.sort_array(F.collect_set("at.line")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Return doc_id, n_lines, n_removed, n_spans, the text that is left and the columns in ``carry``, one row per input row.

    * lines end at ``\\n``; a null text stays null and has no lines;
    * texts under three lines are never touched; an empty text is one empty line;
    * repeats within one document count: of ``a a a a`` the first line stays;
    * rows with the same doc_id and text are one document and are returned
      alike; rows with the same doc_id and other texts are documents in the
      order of their texts' hashes; a null doc_id comes first;
    * a document whose lines all go keeps its row, with an empty text.
    """
    more = {f"carry{i}": c for i, c in enumerate(carry)}
    rows = _lines(docs, doc_id=id_col, text=text_col, **more)
    found = repeated_windows(docs, id_col, text_col).withColumnRenamed("doc_id", "found_id").withColumnRenamed("mark", "found_mark")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left").withColumn("lines", F.expr(LINES))
    # Between repeats k - 1 and k stand the lines from starts[k - 1] + 3 up to starts[k].
    begin = f"if(k = 0, 0, starts[k - 1] + {WINDOW})"
    end = "if(k = size(starts), size(lines), starts[k])"
    kept = F.expr(f"flatten(transform(sequence(0, size(starts)), k -> slice(lines, {begin} + 1, greatest(0, {end} - ({begin})))))")
    spans = F.expr(f"size(filter(starts, (s, k) -> k = 0 or s > starts[k - 1] + {WINDOW}))")
    rows = rows.withColumn("kept", F.when(F.col("starts").isNull(), F.col("lines")).otherwise(kept))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("starts").isNull(), 0).otherwise(spans).cast("long").alias("n_spans"),
        F.when(F.col("text").isNull() | F.col("starts").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        *[F.col(c).alias(name) for c, name in more.items()],
    )


def op10_line_windows(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents
), p AS (
  SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM l WHERE len(x) >= 3
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x[i], x[i + 1], x[i + 2] ORDER BY doc_id, i) AS nth FROM p
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM w, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), lines AS (
  SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM l
), marked AS (
  SELECT lines.doc_id, lines.i, line, covered.i IS NOT NULL AS gone,
         lag(covered.i IS NOT NULL, 1, FALSE) OVER (PARTITION BY lines.doc_id ORDER BY lines.i) AS was
  FROM lines LEFT JOIN covered ON lines.doc_id = covered.doc_id AND lines.i = covered.i
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT was) AS n_spans,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""
