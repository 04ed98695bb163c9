"""Prefix trie of conversations, by an external mergesort that carries common prefixes.

A turn is the digest of its role and text, 16 bytes; a conversation is the
digests of its turns in a row. Equal conversations are one record with their
number, least id and the digest of their ids.

1. Spark deals the distinct records to segments, ranges of their order.
2. A segment's task sorts each batch into a run. A record carries the number of
   turns it shares with the one before it (its LCP); runs beyond a limit go to
   the task's temporary folder. A loser tree merges them: of two records the
   one that shares more turns with the last one out comes first, without a look
   at any turn; only equal numbers make it compare, from there on.
3. The merged stream runs over a stack, the open path. A record closes the
   nodes below what it shares with the one before and opens its own.
4. A segment can't close nodes on its first and last path, which its neighbours
   may share. These are summed up over 64 segments at a time, by the same
   stack, until one group is left.

A node's sums travel to its parent when it is closed, so no node is ever
visited again, whatever the depth.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, small_batches, table

TURN = 16  # bytes of a turn's digest
FAN = 64  # segments summed up by one task
NO_ENDS = hashlib.sha256(b"").hexdigest()
Record = tuple[bytes, list[int], int, int, str]  # turns, bytes of each turn's text, conversations, least id, digest of ids
NODE = "segment long, place long, depth long, id binary, parent_id binary, bytes long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent_conv_id long, is_open boolean, is_first boolean"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id, turns (binary), sizes (array<long>) of every conversation after its head was exchanged.

    A conversation ``c`` begins with the first ``crc32(c) % most`` turns of
    ``c - c % family``, and goes on with its own turns after as many.

    * turns are ordered by number, null first, equal numbers by the digest of role and text;
    * null roles and texts are empty; rows without a conv_id belong to no conversation.

    A conversation's digests (24 bytes a turn, no texts) are held in one task.
    """
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * TURN))
    one = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), one.alias("t")).repartition("base")
    own = rows.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, most - 1))).over(Window.partitionBy("base"))  # of at most ``family`` rows
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    own = own.withColumn("head", F.coalesce(head, F.slice("own", 1, 0))).withColumn("h", h)
    made = own.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("t"))
    return made.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x.digest), "")).alias("turns"), F.transform("t", lambda x: x.size).alias("sizes"))


def ends_of(convs: DataFrame) -> DataFrame:
    """id (digest of the turns), n, least, ends: the conversations with equal turns, and the SHA-256 of their ids, ascending and comma-joined.

    Ids are dealt by range of (turns, id), so that even a group of very many
    copies is sorted and written out by many tasks. SHA-256 has to be taken in
    order; the task that does it gets a group's text in pieces of a batch each.
    """
    ids = convs.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")

    def write_out(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table([batch.column("id"), batch.column("conv_id"), pc.cast(batch.column("conv_id"), pa.string())], names=["id", "conv_id", "text"])
            out = t.group_by("id", use_threads=False).aggregate([("conv_id", "min"), ("conv_id", "count"), ("text", "list")])
            text = pc.binary_join(out["text_list"].combine_chunks(), ",")
            yield pa.RecordBatch.from_arrays([out["id"].combine_chunks(), out["conv_id_min"].combine_chunks(), out["conv_id_count"].combine_chunks(), text], names=["id", "least", "n", "text"])

    pieces = ids.mapInArrow(write_out, "id binary, least long, n long, text string")
    pieces = pieces.repartition("id").sortWithinPartitions("id", "least")

    def digest(batches):
        import pyarrow as pa

        def make(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "n", "least", "ends"])

        now, n, least, sha, done = None, 0, 0, None, []
        for batch in batches:
            for ident, low, count, text in zip(*(batch.column(c).to_pylist() for c in ("id", "least", "n", "text")), strict=True):
                if ident != now:
                    if now is not None:
                        done.append((now, n, least, sha.hexdigest()))
                    now, n, least, sha = ident, 0, low, hashlib.sha256()
                sha.update((("," if n else "") + text).encode())
                n += count
            if done:
                yield make(done)
                done = []
        if now is not None:
            yield make([(now, n, least, sha.hexdigest())])

    return pieces.mapInArrow(digest, "id binary, n long, least long, ends string")


def shared_turns(a: bytes, b: bytes, turns: int = 0) -> int:
    """How many turns two conversations share, of which ``turns`` are known to be."""
    at, most, step = turns * TURN, min(len(a), len(b)), 8 * TURN
    while at + step <= most and a[at : at + step] == b[at : at + step]:
        at += step
    while at < most and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(records: list[Record]) -> list[tuple[int, Record]]:
    """Records in order, each with its LCP."""
    records = sorted(records, key=lambda r: r[0])
    return [(shared_turns(records[i - 1][0], r[0]) if i else 0, r) for i, r in enumerate(records)]


class Runs:
    """Sorted runs: in memory up to ``memory`` bytes of turns, and then in files of a temporary folder."""

    def __init__(self, memory: int, block: int = 1000):
        self.memory, self.block, self.held, self.size, self.folder, self.runs = memory, block, [], 0, None, []

    def add(self, records: list[Record]) -> None:
        self.held.append(sorted_run(records))
        self.size += sum(len(r[0]) + 8 * len(r[1]) + 200 for r in records)
        if self.size > self.memory:
            self.folder = self.folder or tempfile.TemporaryDirectory(prefix="runs-")
            path = f"{self.folder.name}/{len(self.runs)}"
            merged, file = merge(map(iter, self.held)), open(path, "wb")  # noqa: SIM115
            with file:
                while part := [x for _, x in zip(range(self.block), merged)]:  # noqa: B905
                    pickle.dump(part, file)
            self.runs.append(path)
            self.held, self.size = [], 0

    @staticmethod
    def _read(path: str) -> Iterator[tuple[int, Record]]:
        with open(path, "rb") as file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def merged(self) -> Iterator[tuple[int, Record]]:
        yield from merge([*map(self._read, self.runs), *map(iter, self.held)])
        if self.folder:
            self.folder.cleanup()


def merge(runs: Iterable[Iterator[tuple[int, Record]]]) -> Iterator[tuple[int, Record]]:
    """Merge sorted runs with a loser tree; what comes out carries its LCP with the record before."""
    runs = list(runs)
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple[int, Record] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    if size == 1:
        if heads[0]:
            yield heads[0]
            yield from runs[0]
        return

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP becomes that with the winner."""
        if heads[b] is None:
            return a, b
        if heads[a] is None:
            return b, a
        (p, x), (q, y) = heads[a], heads[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = shared_turns(x[0], y[0], p)
        if x[0][n * TURN : (n + 1) * TURN] <= y[0][n * TURN : (n + 1) * TURN]:
            heads[b] = n, y
            return a, b
        heads[a] = n, x
        return b, a

    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    won = build(1)
    while heads[won] is not None:
        yield heads[won]
        heads[won] = next(runs[won], None)
        node = (won + size) // 2
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2


class Node:
    """An open node; its sums are of what ends in it and of its closed children."""

    __slots__ = ("id", "bytes", "n", "least", "children", "leaves", "saved", "ends", "first", "row", "orphans")

    def __init__(self, ident: bytes, size: int, first: bool):
        self.id, self.bytes, self.first = ident, size, first
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, None
        self.orphans: list[list] = []  # rows of closed children, which learn the least id of this node when it is closed

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int, ends: str | None) -> None:
        self.n += n
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = self.ends or ends


class OpenPath:
    """The stack of open nodes of a segment; ``last`` says that nothing comes before or after the segment."""

    def __init__(self, segment: int, last: bool):
        self.segment, self.last, self.stack, self.rows = segment, last, [], []
        self.kept: list[list] = []

    def _row(self, node: Node, depth: int, is_open: bool) -> list:
        parent = self.stack[depth - 1].id if depth else None
        return [self.segment, 0, depth, node.id, parent, node.bytes, node.least, node.n, node.children, node.leaves, node.saved, node.ends, None, is_open, node.first]

    def shrink(self, length: int) -> None:
        """Close what is deeper than the first ``length`` nodes; first paths stay open."""
        while len(self.stack) > length:
            node, depth = self.stack.pop(), len(self.stack)
            if node.first and not self.last:
                self.kept.append(self._row(node, depth, True))
                continue
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.bytes
            row = self._row(node, depth, False)
            for r in node.orphans:
                r[12] = node.least
            self.rows.append(row)
            if depth:
                self.stack[-1].add(node.n, node.least, 1, node.leaves, node.saved, None)
                self.stack[-1].orphans.append(row)

    def push(self, node: Node) -> None:
        self.stack.append(node)

    def finish(self) -> list[list]:
        """Rows of closed nodes, then of open ones in the order of a walk: the first path, then what the last one adds."""
        if self.last:
            self.shrink(0)
        first, rest = self.kept, []
        while self.stack:
            node, depth = self.stack.pop(), len(self.stack)
            (first if node.first else rest).append(self._row(node, depth, True))
        out = sorted(first, key=lambda r: r[2]) + sorted(rest, key=lambda r: r[2])
        for place, row in enumerate(out):
            row[1] = place
        return self.rows + out


def walk(stream: Iterable[tuple[int, Record]], segment: int) -> list[list]:
    """A segment's nodes from its merged records."""
    path = OpenPath(segment, last=False)
    before = None
    hashes = [hashlib.sha256()]  # of the open path; a node's id is the digest of all its turns
    for lcp, (turns, sizes, n, least, ends) in stream:
        if before is None:
            path.push(Node(hashes[0].digest(), 0, True))
        path.shrink(lcp + 1)
        del hashes[lcp + 1 :]
        for k in range(lcp, len(sizes)):
            sha = hashes[-1].copy()
            sha.update(turns[k * TURN : (k + 1) * TURN])
            hashes.append(sha)
            path.push(Node(sha.digest(), sizes[k], before is None))
        path.stack[-1].add(n, least, 0, 0, 0, ends)
        before = turns
    return path.finish()


def combine(partial: Iterable[tuple], segment: int, last: bool) -> list[list]:
    """Sum up open nodes of neighbouring segments, in order of segment and place."""
    path, first_of = OpenPath(segment, last), None
    for source, _, depth, ident, _, size, least, n, children, leaves, saved, ends, _, _, is_first in partial:
        first_of = source if first_of is None else first_of
        if depth >= len(path.stack) or path.stack[depth].id != ident:
            path.shrink(depth)
            path.push(Node(ident, size, bool(is_first) and source == first_of))
        path.stack[depth].add(n, least, children, leaves, saved, ends)
    return path.finish()


def _table(rows: list[list]):
    import pyarrow as pa

    kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=COLUMNS)


def _one_group(last: bool):
    def run(key, partial):
        rows = sorted(zip(*(partial.column(c).to_pylist() for c in COLUMNS), strict=True), key=lambda r: (r[0], r[1]))
        return _table(combine(rows, key[0].as_py(), last))

    return run


def prefix_trie(turns: DataFrame, family: int = 5, most: int = 9, segment_turns: int = 16_384, memory: int = 64 << 20) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role, text; other columns don't matter, names
    that differ in case only neither. A turn that repeats is a turn of its own.
    No conversation gives no node; one without turns ends in the root. Segments
    have about ``segment_turns`` turns, up to 16 times as many where there
    would be over 4,096 of them.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    small_batches(spark, 4096)
    convs = rebuilt(turns, family, most)
    convs = scratch.keep(convs.withColumn("id", F.unhex(F.sha2("turns", 256))), "convs")
    ends = ends_of(convs)
    distinct = convs.drop("id").join(ends, convs.conv_id == ends.least).select("turns", "sizes", "n", "least", "ends")
    distinct = scratch.keep(distinct, "distinct")
    total = distinct.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    segments = max(1, min(-(-total // segment_turns), max(4096, -(-total // (16 * segment_turns)))))

    def one_segment(batches):
        from pyspark import TaskContext

        runs = Runs(memory)
        for batch in batches:
            if batch.num_rows:
                runs.add(list(zip(*(batch.column(c).to_pylist() for c in ("turns", "sizes", "n", "least", "ends")), strict=True)))
        yield from _table(walk(runs.merged(), TaskContext.get().partitionId())).to_batches(10_000)

    nodes = scratch.keep(distinct.repartitionByRange(segments, "turns").mapInArrow(one_segment, NODE), "nodes")
    levels, left = [nodes], segments
    while True:
        left = -(-left // FAN)
        last = left == 1

        opened = levels[-1].where("is_open").withColumn("group", F.expr(f"segment div {FAN}"))
        opened = opened.groupBy("group").applyInArrow(_one_group(last), NODE)
        levels.append(scratch.keep(opened, "nodes"))
        if last:
            break
    return _resolved(levels)


def _resolved(levels: list[DataFrame]) -> DataFrame:
    """Closed nodes of all levels. A parent that stayed open in its segment is looked up by segment, never by its id alone: the root has very many children."""
    tagged = [df.withColumn("level", F.lit(i)) for i, df in enumerate(levels)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    upper = every.where("level > 0 AND NOT is_open").select("id", F.col("conv_id").alias("known"))
    known = every.where("is_open").select("level", "segment", "id").join(upper, "id").select("level", "segment", F.col("id").alias("parent_id"), "known")
    closed = every.where("NOT is_open").join(known, ["level", "segment", "parent_id"], "left")
    return closed.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "known").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op12_merged_prefixes(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal conv_id, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k FROM t),
c AS (SELECT conv_id, {_CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, k, d, strlen(text) AS b FROM c JOIN o ON o.conv_id = c.base WHERE k <= h
  UNION ALL SELECT c.conv_id, 1000000 + k, d, strlen(text) FROM c JOIN o ON o.conv_id = c.conv_id WHERE k > h),
p AS (SELECT conv_id, list(d ORDER BY k) AS path, list(b ORDER BY k) AS sizes FROM r GROUP BY conv_id),
m AS (SELECT c.conv_id, coalesce(path, []) AS path, coalesce(sizes, []) AS sizes FROM c LEFT JOIN p USING (conv_id)),
e AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path, sizes FROM m),
n AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(min(sizes[depth]), 0) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(path)), '')) AS ends_sha256
  FROM e GROUP BY ALL),
x AS (
  SELECT node, any_value(depth) AS depth, any_value(conv_id) AS conv_id, any_value(n_convs) AS n_convs, any_value(size) AS size, any_value(ends_sha256) AS ends_sha256
  FROM n GROUP BY node),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM x WHERE depth > 0 GROUP BY ALL),
y AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM x LEFT JOIN kids USING (node)),
up AS (SELECT node, unnest(range(0, depth + 1)) AS a, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * size AS saved FROM y),
s AS (SELECT node[1:a] AS node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT y.conv_id, y.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, y.n_convs, y.n_children, n_leaves, saved_tokens, y.ends_sha256
FROM y JOIN s USING (node) LEFT JOIN y AS q ON y.depth > 0 AND q.node = y.node[1:y.depth - 1]
"""
