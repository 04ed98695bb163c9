"""N-gram Jaccard join by grouped prefixes.

Two sets of sizes a <= b with a Jaccard similarity of ``t`` share one of the
first ``n - ceil(t n) + 1`` shingles of each, in any one order of all shingles,
and a >= t b. The order here is: rare first.

1. Frequencies: each task counts its documents' shingles in chunks and passes
   on those it saw twice or more; their sums go, as a logarithm, into a table of
   fixed size. It only orders shingles; what it gets wrong costs time, not links.
2. Every document becomes its set's size and hash, its prefix and a parity
   bitmap of the set with about a bit for each shingle. Equal sets are one
   record; records of equal prefix and size are one group.
3. Groups meet by prefix shingles within ranges of sizes. In the first round each
   group is paired with one leader per shingle and size class, and with its own
   members; links give components. Further rounds pair a group of each component
   with one of another, as long as many of those link. The last one takes every
   pair of groups that shares a prefix shingle, passes the size and position
   filters and holds members of different components, and only then expands it to
   its members. Groups of one record carry 512 parity bits in this join, so it makes
   no row for most of the pairs that aren't similar. So a large group of copies costs one check a member, and no link
   between different components is lost.
4. Of two sets the bitmaps differ in at most as many bits as the sets in
   shingles: pairs that this bound rules out go before any text is fetched. The
   others are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, small_batches, table
from boardflow.llm.components import connected_components
from boardflow.llm.filters import build_filter

TABLE_BITS = 21
CHUNK = 1 << 21  # shingles counted at once
PART = 1 << 20  # bytes of short texts that are hashed at once
SHORT = 24  # bits of a shingle's hash that are left out where it is only counted
OFTEN = 4
WORTHWHILE = 4  # a round that draws pairs is followed by another if one in so many links
ENOUGH = 8  # pairs left for each row left, before any filter, with which the last round begins
FOLD = 512  # parity bits that the last round's join itself looks at
RANGE = 6  # size classes in a range within which groups meet

BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``b`` begin, and a hash of each."""
    blank = BLANK[b]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    longest = int(sizes.max())
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest - 1, BASE)]))
    head = starts[0]
    place = np.arange(head, len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    value = np.where(blank[head:], np.uint64(0), (b[head:].astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, longest - 1)])
    return starts, _mix(np.add.reduceat(value, starts - head) + sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``words`` words; fewer words are one shingle, none give no shingle.

    A-Z are lower-cased; words end at blanks and the control characters 9 to 13.
    """
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    ends = np.cumsum([len(r) for r in raw]) // PART  # texts that end in one range of bytes are done at once
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(raw)] if raw else []
    return [s for lo, hi in zip(edges[:-1], edges[1:], strict=True) for s in _sets(raw[lo:hi], words)]


def _sets(raw: list[bytes], words: int) -> list[np.ndarray]:
    starts, w = _word_hashes(np.frombuffer(b"\n".join(raw), dtype=np.uint8))
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    upto = np.searchsorted(starts, begins)

    def combine(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), np.uint64(len(parts)), dtype=np.uint64)
        for i, part in enumerate(parts):
            h = (h + part) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            h ^= h >> np.uint64(32)
        return _mix(h)

    n = len(w) - words + 1
    every = combine([w[i : i + n] for i in range(words)]) if n > 0 else w[:0]
    out = []
    for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if hi - lo >= words:
            h = np.sort(every[lo : hi - words + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(combine([w[i : i + 1] for i in range(lo, hi)]) if hi > lo else w[:0])
    return out


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each value that so many hashes of the set end in, a power of two of them: whether their number is odd."""
    size = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def parity_fold(s: np.ndarray) -> list[int]:
    """``FOLD`` such bits, for sets of any size, as longs."""
    bits = np.bincount((s & np.uint64(FOLD - 1)).astype(np.int64), minlength=FOLD).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64).tolist()


def may_link(n_a: int, n_b: int, a: bytes, b: bytes, percent: int) -> bool:
    """Whether sets of these sizes and parity bits can be similar enough: each differing bit is a shingle that only one has."""
    x, y = (np.frombuffer(bits, dtype=np.uint8) for bits in ((a, b) if len(a) <= len(b) else (b, a)))
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    same = (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2
    return 100 * same >= percent * (n_a + n_b - same)


def _frequencies(rows: DataFrame, words: int) -> np.ndarray:
    """Table of the logarithm of about how many documents have a shingle, by the shingle's upper bits."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def often() -> pd.DataFrame:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"h": h[c > 1].view(np.int64), "n": c[c > 1].astype(np.int64)})

        for pdf in batches:
            for found in shingle_sets(list(pdf["text"]), words):
                held.append(found)
                n += len(found)
                if n >= CHUNK:
                    yield often()
                    held, n = [], 0
        if n:
            yield often()

    often = rows.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    slot = F.shiftrightunsigned("h", 64 - TABLE_BITS).cast("int")
    found = often.groupBy(slot.alias("slot")).agg(F.max(F.log2("n")).cast("int").alias("log")).toPandas()  # a row per slot at most
    out = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    out[found["slot"].to_numpy()] = found["log"].to_numpy()
    return out


def _sketches(rows: DataFrame, words: int, percent: int, often: np.ndarray) -> DataFrame:
    """All columns but the text, n (size of the set), h1, h2 (hash of the set), p1 (hash of prefix and size), prefix, bits and fold (parity)."""
    carried = [f for f in rows.schema.fields if f.name != "text"]
    table = rows.sparkSession.sparkContext.broadcast(often)  # 1 << TABLE_BITS bytes

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            n, h1, h2, p1, ends, parts, bits, fold = [], [], [], [], [0], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                rank = table.value[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                size = int(prefix_length(len(s), percent)) if len(s) else 0
                first = s[np.argsort(rank, kind="stable")[:size]]  # s is sorted: by frequency, then by hash
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append(both >> 64)
                h2.append(both & (2**64 - 1))
                p1.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=len(s)))
                parts.append(first)
                bits.append(parity_bits(s) if len(s) else None)
                fold.append(parity_fold(s) if len(s) else None)
                ends.append(ends[-1] + size)
            long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), long(np.concatenate(parts) if parts else []))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), pa.array(n, pa.int64()), long(h1), long(h2), long(p1), prefix, pa.array(bits, pa.binary()), pa.array(fold, pa.list_(pa.int64()))], names=[*(f.name for f in carried), "n", "h1", "h2", "p1", "prefix", "bits", "fold"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried)
    return rows.mapInArrow(sketch, f"{kinds}, n long, h1 long, h2 long, p1 long, prefix array<long>, bits binary, fold array<long>")


def _whole_texts(rows: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """rec and packed (compressed text, a third of its set's size) of the wanted records (rec, n, h1, h2, least).

    Only texts whose doc_id may be a wanted record's least one are looked at.
    """
    spark = rows.sparkSession
    ids = wanted.select(F.xxhash64("least").alias("h"))
    filter_ = spark.sparkContext.broadcast(build_filter(ids, wanted.count()))

    def may(h: pd.Series) -> pd.Series:
        return pd.Series(filter_.value.has(h.to_numpy().astype(np.int64).view(np.uint64)))

    def pack(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for t, s in zip(texts, shingle_sets(texts, words), strict=True):
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((len(s), both >> 64, both & (2**64 - 1), press.compress((t or "").encode("utf-8", "replace"))))
            n, h1, h2, packed = zip(*out, strict=True) if out else ((), (), (), ())
            long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), long(h1), long(h2), pa.array(packed, pa.binary())], names=["n", "h1", "h2", "packed"])

    found = rows.where(F.pandas_udf(may, "boolean")(F.xxhash64("doc_id"))).select("text")
    made = found.mapInArrow(pack, "n long, h1 long, h2 long, packed binary")
    return made.join(wanted, ["n", "h1", "h2"]).select("rec", "packed").dropDuplicates(["rec"])


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs a, b of records whose sets, made anew from their texts, are similar enough."""
    both = pairs.join(texts.select(F.col("rec").alias("a"), F.col("packed").alias("x")), "a")
    both = both.join(texts.select(F.col("rec").alias("b"), F.col("packed").alias("y")), "b")

    def verify(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def of(packed: bytes) -> np.ndarray:
            return shingle_sets([unpack.decompress(packed).decode()], words)[0]

        last, y = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            hit = []
            for b, x, packed in zip(batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if b != last:
                    last, y = b, of(packed.as_py())
                z = np.concatenate([of(x.as_py()), y])
                z.sort(kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                hit.append(100 * same >= percent * (len(z) - same))
            at = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(at), batch.column("b").filter(at)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _plausible(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of records that their sizes and parity bits don't rule out."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(members.select(F.col("rec").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)

    def may(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True)
            at = pa.array([may_link(*row, percent) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(at), batch.column("b").filter(at)], names=["a", "b"])

    return both.mapInArrow(may, "a long, b long")


def _ranges(percent: int) -> Column:
    """The ranges of sizes that a set of ``n`` shingles is in, as hashes: sets of which one is at most 100 / percent times as large share one."""
    at = F.log(F.col("n").cast("double")) / math.log(100 / percent)
    return F.array_distinct(F.array(F.xxhash64(F.floor(at / RANGE)), F.xxhash64(F.floor((at + (1 + 1e-6)) / RANGE))))


def _postings(sketched: DataFrame, groups: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """gid, n, range, pos, token: the prefixes of the groups' first records, without shingles that no other group of such a size has.

    Of a pair the set that isn't the larger one has its first common shingle so
    early that a set of its own size could still be similar enough; so a shingle
    counts only where it stands that early in one of its sets. Two Bloom filters
    keep what can't pair out of the shuffles: one of the groups' first records, and
    one of the shingles, with a range of sizes, counted twice or more. What passes by
    chance finds no partner, or goes in the last join.
    """
    spark = sketched.sparkSession
    heads = groups.select(F.xxhash64("rec").alias("h"))
    head = spark.sparkContext.broadcast(build_filter(heads, heads.count()))

    def is_head(h: pd.Series) -> pd.Series:
        return pd.Series(head.value.has(h.to_numpy().astype(np.int64).view(np.uint64)))

    rows = sketched.where("n > 0").select("row", "n", F.xxhash64("row").alias("h"), "prefix", _ranges(percent).alias("ranges"))
    leading = rows.where(F.pandas_udf(is_head, "boolean")("h")).drop("h")
    ranged = leading.select("n", F.explode("ranges").alias("range"), "prefix").select("n", "range", F.posexplode("prefix").alias("pos", "t"))
    early = (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")
    often = ranged.select(F.shiftrightunsigned(F.col("t").bitwiseXOR(F.col("range")), SHORT).alias("h"), early.alias("early"))
    often = often.groupBy("h").agg(F.count("*").alias("k"), F.max("early").alias("early")).where("k > 1 and early")
    often = scratch.keep(often.select("h"), "often")
    token = spark.sparkContext.broadcast(build_filter(often, often.count()))
    scratch.drop(often)

    def kept(batches):
        import pyarrow as pa

        long = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in batches:
            prefix, ranges = batch.column("prefix"), batch.column("ranges")
            sizes, values = long(prefix.value_lengths()), long(prefix.flatten())
            begins, salts, of = np.cumsum(sizes) - sizes, long(ranges.flatten()), np.repeat(np.arange(len(sizes)), long(ranges.value_lengths()))
            owner = np.repeat(np.arange(len(of)), sizes[of])  # a row for each document, range and shingle
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[of]) - sizes[of], sizes[of])
            t = values[begins[of[owner]] + pos]
            at = np.flatnonzero(token.value.has((t ^ salts[owner]).view(np.uint64) >> np.uint64(SHORT)))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(of[owner[at]])), pa.array(salts[owner[at]]), pa.array(pos[at].astype(np.int32)), pa.array(t[at])], names=["gid", "range", "pos", "token"])

    found = leading.mapInArrow(kept, "gid long, range long, pos int, token long")
    return found.join(groups.select(F.col("rec").alias("gid"), "n"), "gid")


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Link documents of a Jaccard similarity of at least ``percent`` / 100: doc_id, n_shingles, component_id, one row per input row.

    It gives components, neither pairs nor a document's number of links: pairs
    inside a component that is known already aren't verified.
    ``component_id`` is the smallest doc_id that links reach. A null text or one
    without words has 0 shingles, links with nothing and is its own component.
    Repeated rows link like copies. Null ids are never the smallest, but where a
    component has no other. An empty table gives no rows.

    With ``carry`` follow the columns named there, as they are, and ``component``,
    a number of its own for each component (null without words): where ids are
    repeated or null, different components may have one component_id.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    scratch = Scratch(spark, "jaccard")
    rows = pick(docs, doc_id=id_col, text=text_col)
    carried = [f"carry{i}" for i in range(len(carry))]
    carrying = pick(docs, doc_id=id_col, text=text_col, **dict(zip(carried, carry, strict=True)))
    sketched = _sketches(carrying, words, percent, _frequencies(rows, words)).withColumn("row", F.monotonically_increasing_id())
    sketched = scratch.keep(sketched, "sketches")

    # Records: distinct sets. Groups: records of one prefix and size.
    records = sketched.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("row").alias("rec"), F.min("doc_id").alias("least"), F.first("p1").alias("p1"))
    records = scratch.keep(records, "records")
    groups = scratch.keep(records.groupBy("n", "p1").agg(F.min("rec").alias("rec"), F.count("*").alias("members")), "groups")
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))
    postings = scratch.keep(_postings(sketched, groups, percent, scratch).withColumn("class", size_class), "postings")

    heads = postings.select("gid").unionByName(groups.where("members > 1").select(F.col("rec").alias("gid"))).distinct()
    members = records.join(groups.select("n", "p1", F.col("rec").alias("gid"), "members"), ["n", "p1"]).select("rec", "gid", "n", "h1", "h2", "least", "members")
    members = members.join(heads, "gid").join(sketched.select(F.col("row").alias("rec"), "bits", "fold"), "rec")
    members = members.withColumn("fold", F.when(F.col("members") == 1, F.col("fold"))).drop("members")  # it speaks for one set, not for a group
    members = scratch.keep(members, "members")
    texts = None

    def verified(pairs: DataFrame) -> DataFrame:
        nonlocal texts
        pairs = scratch.keep(_plausible(pairs, members, percent), "plausible")
        named = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct(), "named")
        wanted = named if texts is None else named.join(texts.select("rec"), "rec", "left_anti")
        wanted = scratch.keep(members.join(wanted, "rec").select("rec", "n", "h1", "h2", "least"), "wanted")
        more = scratch.keep(_whole_texts(rows, words, wanted), "texts")  # each text is fetched once
        used = more if texts is None else more.unionByName(texts.join(named, "rec", "left_semi"))
        texts = more if texts is None else texts.unionByName(more)
        linked = scratch.keep(_verified(pairs, used, words, percent), "linked")
        for read in (named, wanted, pairs):
            scratch.drop(read)
        return linked

    needed = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / F.lit(100 + percent))
    reach = 1 + F.least(F.col("a.n") - F.col("a.pos") - 1, F.col("b.n") - F.col("b.pos") - 1) >= needed
    near = (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & reach
    odd = sum(F.bit_count(F.col("a.fold")[i].bitwiseXOR(F.col("b.fold")[i])) for i in range(FOLD // 64))  # at most the shingles that one set has alone
    alike = F.coalesce((100 + percent) * (F.col("a.n") + F.col("b.n") - odd) >= 2 * percent * (F.col("a.n") + F.col("b.n")), F.lit(True))
    pair = [F.least("a.gid", "b.gid").alias("a"), F.greatest("a.gid", "b.gid").alias("b")]

    # First round: one leader for a shingle and a size class, and a group's own members.
    lead = postings.groupBy("token", "range", "class").agg(F.min(F.struct("gid", "n", "pos")).alias("lead"), F.count("*").alias("k")).where("k > 1")
    lead = lead.select("token", "range", "class", "lead.gid", "lead.n", "lead.pos")
    first = postings.alias("a").join(lead.alias("b"), ["token", "range", "class"]).where((F.col("a.gid") != F.col("b.gid")) & near).select(*pair)
    own = members.where("rec != gid").select(F.least("rec", "gid").alias("a"), F.greatest("rec", "gid").alias("b"))
    done = scratch.keep(first.unionByName(own).distinct(), "pairs")
    links = verified(done)

    turn, merging = 0, True
    while True:
        joined = connected_components(links, scratch)
        known = members.select("rec", "gid").join(joined.withColumnRenamed("node", "rec"), "rec", "left").select("rec", "gid", F.coalesce("component", "rec").alias("comp"))
        known = scratch.keep(known, "known")
        # A group's components: the least, the greatest and its first record's.
        spread = known.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("rec") == F.col("gid"), F.col("comp"))).alias("comp"))
        open_ = postings.join(spread, "gid")
        mixed = open_.groupBy("token", "range").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least != most").select("token", "range")
        open_ = scratch.keep(open_.join(mixed, ["token", "range"]), "open")
        # Pairs of different components that share a shingle: few enough to take them all?
        sizes = open_.groupBy("token", "range", "comp").agg(F.count("*").cast("double").alias("k")).groupBy("token", "range").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        rows_open, apart = sizes.agg(F.sum("k"), F.sum(F.col("k") * F.col("k") - F.col("kk")) / 2).first()
        last = not merging or (apart or 0) <= ENOUGH * (rows_open or 0)
        if last:
            differ = (F.col("a.gid") < F.col("b.gid")) & (F.least("a.low", "b.low") != F.greatest("a.high", "b.high"))
            folded = open_.join(members.where("fold is not null").select("gid", "fold"), "gid", "left")
            found = folded.alias("a").join(folded.alias("b"), ["token", "range"]).where(differ & near & alike).select(*pair)
            found = found.unionByName(spread.where("low != high").select(F.col("gid").alias("a"), F.col("gid").alias("b"))).distinct()
            one, two = (known.select(F.col("gid").alias(side), F.col("rec").alias(f"rec_{side}"), F.col("comp").alias(f"comp_{side}")) for side in ("a", "b"))
            found = found.join(one, "a").join(two, "b").where("comp_a < comp_b or (comp_a > comp_b and a != b)")
            found = found.select(F.least("rec_a", "rec_b").alias("a"), F.greatest("rec_a", "rec_b").alias("b"))
        else:  # of each component a group drawn anew each turn meets one of its size class, and one of the class before
            drawn = F.struct(F.xxhash64("gid", F.lit(turn)).alias("draw"), "gid", "n", "pos", "comp")
            some = open_.groupBy("token", "range", "class", "comp").agg(F.min(drawn).alias("r")).select("token", "range", "class", "comp", "r.gid", "r.n", "r.pos", "r.draw")
            b = some.groupBy("token", "range", "class").agg(F.min(drawn).alias("r")).select("token", "range", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), "r.gid", "r.n", "r.pos", "r.comp")
            found = some.alias("a").join(b.alias("b"), ["token", "range", "class"]).where((F.col("a.comp") != F.col("b.comp")) & near).select(*pair)
        pairs = scratch.keep(found.distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        more = verified(pairs)
        scratch.drop(open_)
        scratch.drop(known)
        merging = more.count() * WORTHWHILE > pairs.count()
        links, done, turn = links.unionByName(more), done.unionByName(pairs), turn + 1
        if last:
            break

    joined = connected_components(links, scratch).withColumnRenamed("node", "rec")
    named = records.join(joined, "rec", "left").withColumn("component", F.coalesce("component", "rec"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("n", "h1", "h2", "component").join(least, "component").select("n", "h1", "h2", "component_id", *(["component"] if carry else []))
    tail = [*carried, "component"] if carry else []
    out = sketched.where("n > 0").select("doc_id", "n", "h1", "h2", *carried).join(named, ["n", "h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *tail)
    alone = sketched.where("n = 0").withColumn("component", F.lit(None).cast("long"))
    out = out.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *tail))
    return out.toDF("doc_id", "n_shingles", "component_id", *carry, *(["component"] if carry else []))


def op1_grouped_prefixes(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), words=4, percent=85)
