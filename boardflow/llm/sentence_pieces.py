"""SentencePiece encoding of merge-type models, exact, by backtracking.

A text is its encoding if every piece alone encodes to itself and every two
neighbours together do; there is one such sequence for each text that has any.
So pieces are taken greedily, the longest match first, and checked against the
piece before by merging both anew; where no piece fits, the position is marked
as failed, the last piece goes, and a shorter one is tried. An automaton finds
the longest match at every position of a batch's new words in one pass.

Words are cut where no piece reaches across: before a blank that follows
another letter, if no piece of the model holds such a place, and around letters
that no piece has, which become bytes. Words are remembered within a worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import pick, small_batches, table

BLANK = "▁"
LEFT_OUT = "\n"  # between words that the automaton reads at once; any letter would do that is cut from matches by their ends
MOST_WORDS, MOST_PAIRS = 400_000, 1_000_000  # that a worker remembers
LONG = 256  # letters of a word; longer ones aren't remembered


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer's message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        head = varint()
        if head & 7 == 0:
            yield head >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(head & 7) or varint()
        yield head >> 3, data[at : at + size]
        at += size


class Pieces:
    """A merge-type model with byte fallback; texts are only prefixed and given visible blanks, not normalised otherwise."""

    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        model = list(_fields(self.library.serialized_model_proto()))
        trainer, normal = (dict(_fields(next((v for f, v in model if f == k), b""))) for k in (2, 3))
        entries = [dict(_fields(v)) for f, v in model if f == 1]
        kinds = [e.get(3, self.NORMAL) for e in entries]
        plain = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1) and not trainer.get(24, 0)
        if trainer.get(3, 1) != 2 or not plain or kinds.count(self.BYTE) != 256 or not set(kinds) <= {self.NORMAL, self.UNKNOWN, self.CONTROL, self.BYTE}:
            raise ValueError("only merge-type models with bytes for unknown letters, an identity normaliser and no user-defined or unused pieces are encoded")
        self.text = [e[1].decode() for e in entries]
        self.score = [struct.unpack("<f", e.get(2, b"\0" * 4))[0] for e in entries]
        self.of_byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == self.BYTE}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == self.NORMAL}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        alone = {t: i for t, i in self.ids.items() if self.merge(t) == [i]}  # others are never in an encoding
        self.shorter = [-1] * len(self.text)
        for t, i in alone.items():
            self.shorter[i] = next((alone[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in alone), -1)
        self.size = [len(t) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, i in alone.items():
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        letters = "".join(re.escape(t) for t in alone if len(t) == 1 and t != BLANK)
        across = any(BLANK in t.lstrip(BLANK) for t in alone)
        known = f"[{letters}{BLANK}]+" if across else f"{BLANK}*[{letters}]+|{BLANK}+"
        self.find = re.compile(f"{known}|(?s:.)").findall

    def merge(self, text: str) -> list[int]:
        """Merge letters by the rule itself: the pair of the best score, the leftmost of them. Only for texts of pieces' lengths."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and score[i] > best:
                    best, at = score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p, -1) for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether two pieces in a row encode to themselves."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return found

    def longest(self, text: str) -> list[int]:
        """The longest piece that begins at each place (-1: none)."""
        best = [-1] * len(text)
        for last, (back, piece) in self.automaton.iter(text):
            best[last - back] = piece  # later ends are longer
        return best

    def search(self, best: list[int], at: int, stop: int) -> list[int]:
        """The encoding of the letters from ``at`` to ``stop``; each of them is a piece."""
        out: list[int] = []
        open_ = bytearray(b"\1") * (stop - at + 1)
        begin, size, shorter, fits = at, self.size, self.shorter, self.fits
        piece = best[at]
        while at < stop:
            last = out[-1] if out else -1
            while piece >= 0:
                then = at + size[piece]
                if then <= stop and open_[then - begin] and (last < 0 or fits(last, piece)):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = then
                piece = best[at] if at < stop else -1
            else:
                open_[at - begin] = 0
                piece = out.pop()
                at -= size[piece]
                piece = shorter[piece]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        best = self.longest(LEFT_OUT.join(words))
        out, at = [], 0
        for w in words:
            stop = at + len(w)
            out.append(self.search(best, at, stop) if best[at] >= 0 else [self.of_byte[b] for b in w.encode("utf-8", "replace")])
            at = stop + 1
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with begin and end; an empty text has only these."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        cut = [self.find(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        here = dict(zip(new, self.encode_words(new), strict=True)) if new else {}
        out = []
        for words in cut:
            ids = [self.begin]
            for w in words:
                ids += known.get(w) or here[w]
            ids.append(self.end)
            out.append(ids)
        known.update((w, ids) for w, ids in here.items() if len(w) <= LONG)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>, begin and end included) of every row; null text is empty; rows that repeat are encoded alike."""
    small_batches(docs.sparkSession, 256)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def encode(batches):
        import pyarrow as pa

        pieces = _pieces(path)
        for batch in batches:
            ids = pieces.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of every row of doc_id and ids; null ids give null."""
    small_batches(encoded.sparkSession, 256)
    rows = pick(encoded, doc_id="doc_id", ids="ids")

    def decode(batches):
        import pyarrow as pa

        pieces = _pieces(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = iter(pieces.decode([i for i in ids if i is not None]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else next(texts) for i in ids], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass over the texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession, 256)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def digest(batches):
        import pyarrow as pa

        pieces = _pieces(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            ids = pieces.encode(batch.column("text").to_pylist())
            decoded = [sha(t.encode("utf-8", "replace")) for t in pieces.decode(ids)]
            of_ids = [sha(np.array(i, dtype="<u4").tobytes()) for i in ids]
            n = pa.array(list(map(len, ids)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(of_ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_backtracked_pieces(spark, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_file())
