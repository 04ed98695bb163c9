"""A Bloom filter of 64-bit hashes, built in tasks and bounded in size.

All bits of a hash lie in one 64-bit word, so the filter is built in slices of
words that never meet before they are small. It only ever saves work: what
passes it by chance is sorted out by a join later.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import power_of_two

BITS_PER_ITEM = 16
MOST_BITS = 1 << 28  # 32 MB; a fuller filter lets more pass
SLICE_WORDS = 8192


def _word_and_mask(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = np.uint64(1)
    mask = (one << (x & np.uint64(63))) | (one << ((x >> np.uint64(6)) & np.uint64(63))) | (one << ((x >> np.uint64(12)) & np.uint64(63)))
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), dtype=np.int64), mask


@dataclass
class HashFilter:
    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        at, mask = _word_and_mask(h, len(self.words).bit_length() - 1)
        return (self.words[at] & mask) == mask


def build_filter(hashes: DataFrame, count: int) -> HashFilter:
    """A filter of the column ``h`` (long); ``count`` is about its number of rows."""
    bits = min(power_of_two(max(1, count * BITS_PER_ITEM / 64)), power_of_two(MOST_BITS / 64))
    slice_bits = min(bits, power_of_two(SLICE_WORDS))

    def number(s: pd.Series) -> pd.Series:
        return pd.Series(_word_and_mask(s.to_numpy().astype(np.int64).view(np.uint64), bits)[0] >> slice_bits)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        at, mask = _word_and_mask(pdf["h"].to_numpy().astype(np.int64).view(np.uint64), bits)
        words = np.zeros(1 << slice_bits, dtype=np.uint64)
        np.bitwise_or.at(words, at & ((1 << slice_bits) - 1), mask)
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "words": [words.tobytes()]})

    sliced = hashes.select("h", F.pandas_udf(number, "long")("h").alias("slice"))
    found = sliced.groupBy("slice").applyInPandas(build, "slice long, words binary").collect()  # MOST_BITS at most
    words = np.zeros(1 << bits, dtype=np.uint64)
    for r in found:
        words[r["slice"] << slice_bits : (r["slice"] + 1) << slice_bits] = np.frombuffer(bytes(r["words"]), dtype=np.uint64)
    return HashFilter(words)
