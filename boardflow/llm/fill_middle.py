"""Fill-in-the-middle: a text is cut in prefix, middle and suffix, and put together with the middle last.

The ``tokenizers`` library's Split pre-tokenizer, with a pattern whose matches
are isolated, tells where tokens begin and end in code points; nothing is
trained. The array of ends gives ``n`` and, by the ranks drawn for a document,
the two cuts. Draws, slices and the way back are SQL functions, so a Python
task returns three numbers for a text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import pick, small_batches, table

#: White space that leads to a word belongs to it. The possessive ``*+`` matches the same and never backtracks over long blanks.
PATTERN = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 1 << 18  # code points that the pre-tokenizer gets at once
#: A token of PATTERN ends wherever white space follows a word.
_BORDER = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


@lru_cache(maxsize=4)
def _split(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str


def token_ends(text: str, pattern: str = PATTERN, block: int = BLOCK) -> np.ndarray:
    """Where each token ends, in code points.

    A long text goes to the pre-tokenizer in blocks that end where a token of
    ``PATTERN`` must; another pattern gets the text at once.
    """
    split, parts, at = _split(pattern), [], 0
    while at < len(text):
        stop = len(text)
        if pattern == PATTERN and stop - at > block and (border := _BORDER.search(text, at + block)):
            stop = border.start()
        found = split(text[at:stop])
        parts.append(np.fromiter((e for _, (_, e) in found), dtype=np.int64, count=len(found)) + at)
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _draw(ident: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of eight hex digits, from 0, of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
    pattern: str = PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, text, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    * null text is empty; an empty text has no token and is plain;
    * a text that holds a marker is plain, so that ``restore`` is exact;
    * a null id draws as the word ``null``; rows that repeat come out alike;
    * lengths of the parts are null where the form is plain.
    """
    small_batches(docs.sparkSession, 256)

    @F.pandas_udf("n long, first long, second long")
    def cuts(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(text), 3), dtype=np.int64)
        for i, (t, a, b) in enumerate(zip(text, one, two, strict=True)):
            ends = token_ends(t, pattern)
            ranks = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
            out[i] = len(ends), *(ends[r - 1] if r else 0 for r in ranks)
        return pd.DataFrame(out, columns=["n", "first", "second"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("c", cuts("text", _draw(F.col("doc_id"), seed, 0), _draw(F.col("doc_id"), seed, 1)))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.pmod(_draw(F.col("doc_id"), seed, 2), F.lit(100)) >= fim_percent)
    spm = F.pmod(_draw(F.col("doc_id"), seed, 3), F.lit(100)) < spm_percent
    rows = rows.withColumn("form", F.when(plain, "plain").when(spm, "spm").otherwise("psm"))
    a, b = F.col("c.first").cast("int"), F.col("c.second").cast("int")
    head, middle, tail = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.char_length("text") - b)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle))
    return rows.select(
        "doc_id",
        "text",
        F.col("c.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", F.col("c.first")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("c.second") - F.col("c.first")).alias("middle_chars"),
        output.otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle)).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of in ``form``. Parts hold no marker, so the first of each kind is the one put there."""
    size = len(PREFIX)
    inner = F.when(form == "psm", F.position(F.lit(SUFFIX), output)).otherwise(F.position(F.lit(PREFIX), output))
    last = F.position(F.lit(MIDDLE), output)
    one = F.substring(output, F.lit(size + 1), inner - size - 1)
    two = F.substring(output, inner + size, last - inner - size)
    middle = F.substring(output, last + size, F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_isolated_split(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t),
v AS (
  SELECT *, len(tokens)::BIGINT AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
w AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:n], '') AS s FROM v)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM w
"""
