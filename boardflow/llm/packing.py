"""Best-fit packing with patterns fitted by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. All that the plan needs
is the histogram of the pieces' lengths, at most ``capacity`` numbers whatever
the size of the corpus:

1. enumerate patterns: one piece, two or three, that fill a sequence exactly or
   but for ``slack`` tokens;
2. fit repeat counts to the histogram by non-negative least squares
   (multiplicative updates), and round down to what the histogram has;
3. pack the residual histogram by best fit, longest first, a whole group of
   equal bins at a time.

The plan is a list of bins' contents with counts. It gives intervals: the
pieces of a length from one rank to another go to consecutive sequences at one
offset. Ranks within a length are taken in cells of a hash of the document, so
a length that a third of all pieces have doesn't meet in one task.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, small_batches, table

CAPACITY = 1024
END_ID = 2
PIECES = "piece int, start long, length long, ids_crc32 long"
Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, times), ...) of a bin, number of such bins


class Tokenizer:
    """Ids as by ``tokenizers`` with the file ``json_path``.

    Texts without one of its special tokens' strings go through the same
    vocabulary's rank file, which gives the same ids faster.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        import tokenizers

        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.slow = tokenizers.Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


@lru_cache(maxsize=2)
def _tokenizer(*files: str) -> Tokenizer:
    return Tokenizer(*files)


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all are full but the first, which takes what is left over."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, files: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens and ``end_id`` (null text: that alone)."""
    import pyarrow as pa

    small_batches(docs.sparkSession, 256)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def split(batches):
        tok = _tokenizer(*files)
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(tok.ids(text), np.array([end_id], dtype="<u4")).astype("<u4")
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    out.append((n, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(split, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def patterns(lengths: np.ndarray, capacity: int, slack: int) -> np.ndarray:
    """Rows of three lengths (0: none), descending, that sum to the capacity but for ``slack``; triples fill it exactly."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    a, b = lengths[:, None], lengths[None, :]
    total = a + b
    y, x = np.nonzero((a >= b) & (total <= capacity) & (total >= capacity - slack))
    two = np.stack([lengths[y], lengths[x], np.zeros(len(y), dtype=np.int64)], axis=1)
    c = capacity - total
    y, x = np.nonzero((a >= b) & (c >= 1) & (c <= b) & have[np.clip(c, 0, capacity)])
    three = np.stack([lengths[y], lengths[x], c[y, x]], axis=1)
    one = lengths[lengths >= capacity - slack]
    one = np.stack([one, np.zeros_like(one), np.zeros_like(one)], axis=1)
    return np.concatenate([one, two, three]).astype(np.int64)


def fit(p: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with least || A x - hist ||, A x being the pieces of each length they use."""
    use = p > 0

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(p[use], weights=np.broadcast_to(x[:, None], p.shape)[use], minlength=len(hist))

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(use, r[p], 0).sum(axis=1)

    h = hist.astype(float)
    goal = back(h)
    x = goal / np.maximum(1, len(p))
    for _ in range(rounds):
        x = x * goal / np.maximum(back(used(x)), 1e-12)
    return x


def best_fit(hist: np.ndarray, capacity: int) -> Plan:
    """Best fit of a histogram, longest pieces first; equal bins are handled as one group."""
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)  # by room left
    count = np.zeros(capacity + 1, dtype=np.int64)

    def put(room: int, inside: tuple[tuple[int, int], ...], bins: int) -> None:
        if bins:
            groups[room].append((inside, bins))
            count[room] += bins

    for length in np.flatnonzero(hist)[::-1].tolist():
        left = int(hist[length])
        while left:
            rooms = np.flatnonzero(count[length:capacity])
            if len(rooms):
                room = length + int(rooms[0])
                inside, bins = groups[room].pop()
                count[room] -= bins
            else:
                room, inside = capacity, ()
                bins = -(-left // (capacity // length))
            each = room // length
            full = min(bins, left // each)
            rest = min(left - full * each, each) if full < bins else 0
            put(room - each * length, (*inside, (length, each)), full)
            put(room - rest * length, (*inside, (length, rest)), 1 if rest else 0)
            put(room, inside, bins - full - (rest > 0)) if inside else None
            left -= full * each + rest
    return [g for room in sorted(groups) for g in groups[room]]


def make_plan(hist: np.ndarray, capacity: int = CAPACITY, slack: int = 2) -> Plan:
    left = hist.copy()
    plan: Plan = []
    lengths = np.flatnonzero(hist[:capacity]).astype(np.int64)
    if len(lengths):
        p = patterns(lengths, capacity, slack)
        x = fit(p, hist[:capacity]) if len(p) else np.zeros(0)
        for i in np.argsort(-x, kind="stable")[: int((x >= 1).sum())].tolist():
            kinds, times = np.unique(p[i][p[i] > 0], return_counts=True)
            bins = min(int(x[i]), *(left[kinds] // times).tolist())
            if bins:
                left[kinds] -= bins * times
                plan.append((tuple(zip(kinds.tolist(), times.tolist(), strict=True)), bins))
    return plan + best_fit(left, capacity)


def intervals(plan: Plan, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """By (length, first rank): the bins and the offset that the pieces of a length get, in order of rank."""
    rows, upto, base = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for inside, bins in plan:
        offset = 0
        for length, times in inside:
            rows.append((length << 44 | int(upto[length]), bins, base, offset, length))
            upto[length] += bins * times
            offset += length * times
        base += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "bins", "base", "offset", "length"), table.T, strict=True))


def pack(found: DataFrame, scratch: Scratch, capacity: int = CAPACITY, slack: int = 2, cell_rows: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to rows of doc_id, piece, start, length (1 to ``capacity``) and ids_crc32."""
    import pyarrow as pa

    found = scratch.keep(found, "pieces")  # the histogram and the ranks need them; tokenizing again would cost more
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # ``capacity`` rows at most
        hist[r["length"]] = r["n"]
    place = intervals(make_plan(hist, capacity, slack), capacity)

    cells = max(1, -(-int(hist.max()) // cell_rows))
    rows = found.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "cell").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_cell = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("nth", F.row_number().over(in_cell)).join(sizes, ["length", "cell"])
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def assign(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << 44) | batch.column("rank").to_numpy()
            at = np.searchsorted(place["key"], key, side="right") - 1
            nth = key - place["key"][at]
            bins = place["bins"][at]
            seq, offset = place["base"][at] + nth % bins, place["offset"][at] + nth // bins * length
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {PIECES}, sequence_id long, offset long"
    return rows.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, files: tuple[str, str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    A null or empty text is the end id alone. Repeated rows and null ids are
    documents like others. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(pieces(docs, files or default_files(), capacity, end_id, id_col, text_col), scratch, capacity)


def op4_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
