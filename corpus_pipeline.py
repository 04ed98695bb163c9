"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept. All but the last
return the columns of ``documents``; a stage that changes texts brings
``n_chars`` up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, table
from boardflow.llm.jaccard_join import link
from boardflow.llm.language_id import UNKNOWN, fit, predict
from boardflow.llm.line_dedup import dedup_lines
from boardflow.llm.packing import pack_documents
from boardflow.llm.suffix_dedup import cut_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of whose n-grams fewer are known in its best language is in none of the learned languages.
LEAST_COVERAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts in no language that the labels teach."""
    rows = pick(docs, **{c: c for c in COLUMNS})
    found = predict(rows, fit(rows.select("text", "lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))), COLUMNS)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three lines in a row; a document of which nothing is left stays, empty."""
    out = dedup_lines(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates (five words, 0.8): with the smallest doc_id, then the smallest hash of the text.

    A null doc_id comes after all others. Rows without words all stay. Of kept
    rows alike in doc_id and text, one stays: the first by its other columns.
    """
    rows = pick(docs, **{c: c for c in COLUMNS})
    key = ["no_id", "id0", "mark"]
    rows = rows.withColumns({"no_id": F.col("doc_id").isNull(), "id0": F.coalesce("doc_id", F.lit(0)), "mark": F.xxhash64("text")})
    scratch = Scratch(spark, "near")
    linked = link(rows, words=5, percent=80, carry=tuple(key))
    alike = linked.where("n_shingles > 0").groupBy("component", *key).agg(F.count("*").alias("copies"))
    kept = alike.groupBy("component").agg(F.min(F.struct(*key, "copies")).alias("r")).select("r.*")
    wordless = linked.where("n_shingles = 0").select(*key, F.lit(0).cast("long").alias("copies")).distinct()
    kept = scratch.keep(kept.unionByName(wordless), "kept")
    out = rows.join(kept.where("copies < 2").select(*key), key).select(*COLUMNS)
    repeated = kept.where("copies > 1").select(*key)
    if repeated.isEmpty():
        return out
    once = rows.groupBy(*key).agg(F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("r"))
    return out.unionByName(once.join(repeated, key).select(*[F.col(f"r.{c}").alias(c) for c in COLUMNS]))


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes or more that stand anywhere else too; a document of which nothing is left stays, empty."""
    out = cut_repeats(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens, a row per piece."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("best_fit_packing", packing),
]

#: Neither the language model nor tokens can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
