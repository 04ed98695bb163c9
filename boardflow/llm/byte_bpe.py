"""Byte-level BPE in length-bucketed padded numpy matrices.

The distinct words (pattern matches) of a batch of texts are put in matrices of
rows of about one length. In each round every row merges its leftmost pair of
minimum rank; the row is compacted by one place, the two pairs beside the merge
are looked up anew in a hash table of pairs, and rows without a pair leave.
Words of over ``LONG`` bytes stand alone and merge all occurrences of a pair in
a round, up to one that makes a pair of lower rank, which gives the same result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import pick, small_batches, table

NONE = np.int32(2**31 - 1)
LONG = 512
WIDTHS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256, LONG]
CELLS = 1 << 20  # of a matrix
MOST_WORDS = 400_000  # that a worker remembers


class Bpe:
    """Ranks of a file in tiktoken's format."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.decimal = {r: str(r) for r in self.tokens}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = np.array(pairs, dtype=np.int64).T
        self._make_table(a << 32 | b, r.astype(np.int32))
        self.forget()

    def _make_table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = int(len(keys) * 3).bit_length()
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is none or where one side is padding (-1)."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        odd = np.flatnonzero((found != keys) & (found != -1))
        while len(odd):
            at[odd] = (at[odd] + 1) & (len(self.keys) - 1)
            found = self.keys[at[odd]]
            hit = found == keys[odd]
            out[odd[hit]] = self.values[at[odd[hit]]]
            odd = odd[~hit & (found != -1)]
        return out

    def _ranks(self, m: np.ndarray) -> np.ndarray:
        out = np.full((len(m), m.shape[1]), NONE, dtype=np.int32)
        if m.shape[1] > 1:
            a, b = m[:, :-1], m[:, 1:]
            y, x = np.nonzero((a >= 0) & (b >= 0))
            out[y, x] = self.pair_ranks(a[y, x], b[y, x])
        return out

    def merge_matrix(self, m: np.ndarray) -> np.ndarray:
        """Merge each row of byte tokens, padded with -1 on the right, to its end."""
        done = np.full_like(m, -1)
        ranks, rows = self._ranks(m), np.arange(len(m))
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(rows)), at]
            live = least != NONE
            if not live.all():
                done[rows[~live], : m.shape[1]] = m[~live]
                m, ranks, rows, at, least = m[live], ranks[live], rows[live], at[live], least[live]
                if not len(rows):
                    break
            every, width = np.arange(len(rows)), m.shape[1]
            m[every, at] = least
            places = np.arange(width - 1)
            places = places + (places > at[:, None])  # the place after the merge goes
            m, ranks = np.take_along_axis(m, places, 1), np.take_along_axis(ranks, places, 1)
            width -= 1
            for left in (at - 1, at):
                y = np.flatnonzero((left >= 0) & (left + 1 < width))
                x = left[y]
                b = m[y, x + 1]
                y, x, b = y[b >= 0], x[b >= 0], b[b >= 0]
                ranks[y, x] = self.pair_ranks(m[y, x], b)
            last = at >= width - 1
            ranks[last, width - 1] = NONE
            at_end = np.flatnonzero(~last & (m[every, np.minimum(at + 1, width - 1)] < 0))
            ranks[at_end, at[at_end]] = NONE
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            r = ranks.min()
            if r == NONE:
                break
            at = np.flatnonzero(ranks == r)
            first = np.concatenate([[True], np.diff(at) > 1])  # of a run of neighbours, every other one merges
            at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            new = np.full(len(at), r, dtype=np.int32)
            follows = np.concatenate([[False], np.diff(at) == 2])
            before = np.where(follows, r, ids[np.maximum(at - 1, 0)])
            worse = (self.pair_ranks(before, new) <= r) & (at > 0)
            after = at + 2 < len(ids)
            worse[after] |= self.pair_ranks(new[after], ids[at[after] + 2]) <= r
            if worse.any():
                at = at[: int(worse.argmax()) + 1]
            ids = ids.copy()
            ids[at] = r
            ids = np.delete(ids, at + 1)
        return ids

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        low = 0
        for width in WIDTHS:
            inside = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            step = max(1, CELLS // width)
            for k in range(0, len(inside), step):
                part = inside[k : k + step]
                raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), dtype=np.uint8).reshape(-1, width)
                m = np.where(np.arange(width) < lengths[part, None], self.of_byte[raw], np.int32(-1))
                m = self.merge_matrix(m)
                sizes = (m >= 0).sum(axis=1)
                for i, row, n in zip(part.tolist(), m, sizes.tolist(), strict=True):
                    out[i] = row[:n]
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self.merge_long(self.of_byte[np.frombuffer(words[i], dtype=np.uint8)])
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, every match of the pattern encoded separately."""
        if len(self.known) > MOST_WORDS:
            self.forget()
        known, before = self.known, len(self.known)
        index, ends = [], []
        for text in texts:
            index.append(np.array([known.setdefault(w, len(known)) for w in self.find(text)], dtype=np.int64))
            ends.append(len(index[-1]))
        if len(known) > before:
            new = self.encode_words([w.encode("utf-8", "replace") for w in list(known)[before:]])
            size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, *new])
        words = np.concatenate(index) if index else np.zeros(0, dtype=np.int64)
        sizes = self.size[words]
        upto = np.cumsum(sizes)
        at = np.repeat(self.begin[words] - (upto - sizes), sizes) + np.arange(int(sizes.sum()))
        cut = np.concatenate([[0], upto])[np.cumsum(ends)[:-1]] if len(texts) > 1 else []
        return np.split(self.flat[at], cut)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row; a null or empty text has none; rows that repeat are encoded alike."""
    small_batches(docs.sparkSession, 256)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": bpe.encode(list(pdf["text"]))})

    return rows.mapInPandas(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of doc_id and ids."""
    small_batches(encoded.sparkSession, 256)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "data": [bpe.decode(list(ids)) for ids in pdf["ids"]]})

    return encoded.mapInPandas(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass over the texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import pyarrow as pa

    small_batches(docs.sparkSession, 256)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def digest(batches):
        bpe = _bpe(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for ids in bpe.encode(batch.column("text").to_pylist()):
                ids = ids.tolist()
                n.append(len(ids))
                of_ids.append(sha(" ".join(map(bpe.decimal.__getitem__, ids)).encode()))
                of_bytes.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_padded_bpe(spark, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), *default_files())
