"""Language identification with bit-sliced Bloom filters of n-grams.

One table of slots serves all languages: bit ``l`` of a slot belongs to the
filter of language ``l`` (a slot has a word of 64 bits for every 64 languages),
so the conjunction of an n-gram's slots is the set of all languages that
contain it. A text's score for a language is the number of
its n-grams with that bit, corrected for false positives: of ``n`` n-grams,
``n * fp`` hits come by chance where ``fp`` is the filter's fill to the power
of the number of hashes.

The filters are fitted on about ``docs_per_lang`` labelled documents of each
language (a bound on the training sample, drawn by a hash of the id): every
n-gram of the sample is in the filter of every language that has it. Every whole
text is then scored. N-grams are four bytes of the lower-cased UTF-8 text, with
everything but letters a blank; one of four blanks is none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, power_of_two, small_batches, table

HASHES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
BLANK = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNKNOWN = "und"
NONE = np.uint32(0x20202020)  # four blanks
DOCS_PER_LANG = 2_000  # a bound on the sample that is fitted
WORD = 64  # languages in a word of a slot
SLOTS_PER_GRAM = 8


@dataclass
class Filters:
    langs: list[str]
    slots: np.ndarray  # uint64, a row for each word, a power of two of columns
    rates: np.ndarray  # false positives of each language

    def masks(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the bits of the languages that contain it, of the languages from ``WORD * word`` on."""
        slots = self.slots[word]
        shift = np.uint32(32 - (len(slots).bit_length() - 1))
        out = slots[(grams * HASHES[0]) >> shift]
        for h in HASHES[1:]:
            out = out & slots[((grams ^ (grams >> np.uint32(15))) * h) >> shift]
        return np.where(grams == NONE, np.uint64(0), out)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, and where each text's begin."""
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(BLANK) + b"    " for t in texts]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    b = np.frombuffer(b"".join(raw) + b"    ", dtype=np.uint8).astype(np.uint32)
    n = int(lengths.sum())
    grams = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16) | b[3 : n + 3] << np.uint32(24)
    ends = np.cumsum(lengths)
    grams[(ends[:, None] - np.arange(1, 4)).ravel()] = NONE  # else the next text would begin in them
    return grams, np.concatenate([[0], ends[:-1]]).astype(np.int64)


def make_filters(langs: list[str], lang: np.ndarray, grams: np.ndarray, bits: int = 18) -> Filters:
    """Filters of n-grams and the number of a language of each."""
    masks = np.zeros((-(-len(langs) // WORD), len(grams)), dtype=np.uint64)
    masks[lang // WORD, np.arange(len(grams))] = np.uint64(1) << (lang % WORD).astype(np.uint64)
    return filled(langs, ((word, grams, m) for word, m in enumerate(masks)), bits)


def filled(langs: list[str], parts: Iterable[tuple[int, np.ndarray, np.ndarray]], bits: int) -> Filters:
    """Filters of n-grams that come in parts: the number of a word, n-grams, and the bits of each one's languages in that word."""
    slots = np.zeros((-(-len(langs) // WORD), 1 << bits), dtype=np.uint64)
    shift = np.uint32(32 - bits)
    for word, grams, masks in parts:
        np.bitwise_or.at(slots[word], (grams * HASHES[0]) >> shift, masks)
        for h in HASHES[1:]:
            np.bitwise_or.at(slots[word], ((grams ^ (grams >> np.uint32(15))) * h) >> shift, masks)
    fill = np.array([float(((slots[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean()) for i in range(len(langs))])
    return Filters(langs, slots, fill ** len(HASHES))


def score_texts(filters: Filters, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Corrected hits (texts x languages) and the number of n-grams with a letter of each text."""
    grams, starts = grams_of(texts)
    letters = np.add.reduceat((grams != NONE).astype(np.int64), starts)
    kinds = np.zeros((len(texts), len(filters.langs)))
    for i in range(len(filters.langs)):
        if i % WORD == 0:
            masks = filters.masks(grams, i // WORD)
        kinds[:, i] = np.add.reduceat(((masks >> np.uint64(i % WORD)) & np.uint64(1)).astype(np.int64), starts)
    rates = filters.rates
    return np.maximum(0, (kinds - letters[:, None] * rates) / (1 - np.minimum(rates, 0.999))).round(6), letters


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Filters:
    """Fit on rows of text, lang (not null) and key, every language.

    Languages are in the order of their numbers of rows, then by name.
    To the driver come the distinct n-grams of the sample with the bits of their
    languages, 64 languages at a time, and as many slots as suit them.
    """
    spark = docs.sparkSession
    docs = docs.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts, key=lambda k: (-counts[k], k))  # where languages tie, the one with most rows is predicted
    if not langs:
        return Filters([], np.zeros((0, 1 << 10), dtype=np.uint64), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20))
    shares = spark.createDataFrame([(k, i // WORD, i % WORD, int(min(1, docs_per_lang / counts[k]) * (1 << 20))) for i, k in enumerate(langs)], "lang string, word int, bit int, share int")
    sample = docs.join(F.broadcast(shares), "lang").where(draw < F.col("share"))  # a row for each language, which the filters have too

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (word, bit), part in pdf.groupby(["word", "bit"]):
                grams = np.unique(grams_of(list(part["text"]))[0])
                yield pd.DataFrame({"word": word, "bit": bit, "gram": grams[grams != NONE].astype(np.int64)})

    found = sample.select("word", "bit", "text").mapInPandas(distinct, "word int, bit int, gram long")
    found = found.groupBy("word", "gram").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    found = Scratch(spark, "langs").keep(found, "grams")
    most = max((r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()), default=0)

    def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for word in range(-(-len(langs) // WORD)):
            some = found.where(F.col("word") == word).toPandas()
            yield word, some["gram"].to_numpy(dtype=np.int64).astype(np.uint32), some["mask"].to_numpy(dtype=np.int64).view(np.uint64)

    return filled(langs, parts(), min(24, max(10, power_of_two(most * SLOTS_PER_GRAM))))


def predict(docs: DataFrame, filters: Filters, keep: list[Column | str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score and coverage, from the column ``text`` alone.

    ``score`` is the best language's part of the two best ones' corrected hits;
    ``coverage`` the best one's part of the text's n-grams. A null text or one
    without a letter is ``und`` with 0 for both. A text with letters of which no
    n-gram is known gets the learned language with most rows and a score of 0; so
    does every text where several languages tie, with their score (of languages
    with equally many rows the first by name). Without any learned language all is
    ``und``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double", "coverage double"])

    def guess(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("_text").to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None] if filters.langs else []
            lang, score, cover = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if at:
                hits, letters = score_texts(filters, [texts[i] for i in at])
                best = hits.argmax(axis=1)
                top = hits[np.arange(len(at)), best]
                two = np.sort(hits, axis=1)[:, -2:].sum(axis=1)
                score[at] = np.where(two > 0, top / np.maximum(two, 1e-9), 0)
                cover[at] = np.minimum(1, top / np.maximum(letters, 1))
                for i, k in zip(at, best, strict=True):
                    lang[i] = filters.langs[k]
            columns = [batch.column(f.name) for f in kept] + [pa.array(lang, pa.string()), pa.array(score), pa.array(cover)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["lang_pred", "score", "coverage"])

    return rows.mapInArrow(guess, schema)


def identify(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict every row's language: doc_id, held_out, lang_pred, score, coverage.

    Rows whose ``crc32(doc_id)`` is divisible by ``folds`` are held out; only
    the others' texts and labels are learned from. A null id counts as an empty
    text there, so it is held out. Rows that repeat are predicted alike.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.select("doc_id", "text", "lang", key.alias("key"), (F.crc32(key.cast("binary")) % folds == 0).alias("held_out"))
    filters = fit(rows.where("not held_out"))
    return predict(rows, filters, ["doc_id", "held_out"])


def op3_language_masks(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
