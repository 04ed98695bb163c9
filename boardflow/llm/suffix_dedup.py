"""Removal of repeated byte strings with per-shard suffix arrays.

Every start of a string of ``window`` bytes belongs to one anchor: the least
hash of a ``GRAM``-byte gram inside the string. Equal strings have equal anchors
at equal places, so it is enough to compare starts with the same anchor hash:

1. Anchor hashes are counted; those seen once can't be part of a repeat. The
   others go into a Bloom filter of bounded size.
2. In a second pass over the texts each run of starts of an anchor in the filter
   becomes a region: the bytes that its strings cover, about 270 of them. Equal
   regions are one content with a number of occurrences.
3. Contents of one anchor hash go to one shard. A shard builds a suffix array of
   its contents (Larsson-Sadakane refinement in numpy), takes the common
   prefixes by Kasai's rule, and every class of suffixes with ``window`` bytes
   in common and two occurrences, of one content or of several, is repeated.
4. A hash with very many different contents is split over several shards. Each
   publishes a digest for every class of its starts; shards are merged by binary
   search in one another's sorted digests, in ranges of digests.
5. Repeated starts become byte ranges of documents and are cut out.

No task holds more than its shard; exact copies, however many, are one content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, small_batches, table
from boardflow.llm.filters import build_filter

WINDOW = 200
GRAM = 64
SEGMENT = 1 << 22  # starts of a very long text that are handled at once
SHARD_BYTES = 1 << 19  # a task's arrays take about 120 times as much
SPLIT = 2048  # contents of one hash in a shard
MOST_TASKS = 20_000  # tasks that shards are dealt over; beyond that many a task has several, one after the other
MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * i & (2**64 - 1) | 1) for i in range(2)]


def gram_hashes(b: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``length`` bytes of ``b``, from hashes of powers of two of bytes."""
    h, size, out, taken = (b.astype(np.uint64) + np.uint64(seed + 1)) * MULTIPLIERS[seed], 1, None, 0
    left = length
    while left:
        if left & 1:
            part = h[taken:]
            out = part if out is None else (out[: len(part)] ^ (out[: len(part)] >> np.uint64(31))) * MULTIPLIERS[seed] + part
            taken += size
        left >>= 1
        if left:
            h = h[:-size] * MULTIPLIERS[seed] + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
    return out[: max(0, len(b) - length + 1)]


def anchors(b: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each run of starts with one anchor: the hash, the first start, the number of starts."""
    w = window - gram + 1
    starts = len(b) - window + 1
    for base in range(0, max(0, starts), SEGMENT):
        part = b[base : base + SEGMENT + window - 1]
        h = gram_hashes(part, gram)
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        low, size = key, 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: len(key) - w + 1], low[w - size :])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        yield h[at[begin]], base + begin, np.diff(np.append(begin, len(at)))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by the first bytes, then refine groups of equal rank by the rank ``depth`` further on."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(6):
        key = key * 257 + padded[i : i + n]
    sa = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, dtype=np.int64)

    def regroup(at: np.ndarray, first: np.ndarray, new: np.ndarray) -> np.ndarray:
        """``at``: places in sa of the suffixes just sorted; ``new`` marks where a group begins. Ranks are places of group ends."""
        group = np.cumsum(new) - 1
        ends = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        rank[sa[at]] = ends[group] + 1
        single = new & np.append(new[1:], True)
        return at[~single]

    sorted_key = key[sa]
    open_ = regroup(np.arange(n), sa, np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    depth = 6
    while len(open_):
        s = sa[open_]
        second = rank[np.minimum(s + depth, n)]
        both = rank[s] * (n + 2) + second
        order = np.argsort(both, kind="stable")
        sa[open_] = s[order]
        both = both[order]
        open_ = regroup(open_, s, np.concatenate([[True], both[1:] != both[:-1]]))
        depth *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the array and the one before it (0 for the first).

    Kasai's rule: going through the text, the length falls by one where the
    bytes before both suffixes are equal; only at other places are bytes compared.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    falls = np.zeros(n, dtype=bool)
    falls[1:] = (before[1:] > 0) & (before[1:] - 1 == before[:-1]) & (text[:-1] == text[before[1:] - 1])
    at = np.flatnonzero(~falls & (before >= 0))
    length = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    active, a, b = at, at.copy(), before[at].copy()
    while len(active):
        same = words[np.minimum(a, n)] == words[np.minimum(b, n)]
        room = n - np.maximum(a, b)
        step = np.minimum(np.where(same.all(axis=1), 8, same.argmin(axis=1)), room)
        length[active] += step
        on = step == 8
        active, a, b = active[on], a[on] + 8, b[on] + 8
    last = np.maximum.accumulate(np.where(falls, 0, i))
    plcp = np.where(before >= 0, np.maximum(0, length[last] - (i - last)), 0)
    return plcp[sa]


def repeated_starts(contents: list[bytes], window: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the contents joined: which places are starts, the class of each start (-1 elsewhere), and whether its class occurs twice.

    ``times``: how often each content occurs, once if not given.
    """
    text = np.frombuffer(b"".join(contents), dtype=np.uint8)
    sizes = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    ends = np.repeat(np.cumsum(sizes), sizes)
    is_start = ends - np.arange(len(text)) >= window
    sa = suffix_array(text)
    group = np.cumsum(common_prefixes(text, sa) < window) - 1
    of = np.full(len(text), -1, dtype=np.int64)
    of[sa] = group
    of[~is_start] = -1
    weight = None if times is None else np.repeat(np.minimum(times, 2), sizes)[is_start]
    many = np.bincount(of[is_start], weight, minlength=int(group[-1]) + 1 if len(group) else 0) >= 2
    return is_start, of, np.where(of >= 0, many[of], False)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pair(h: int) -> tuple[int, int]:
    a, b = h >> 64, h & (2**64 - 1)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    more = {f"carry{i}": c for i, c in enumerate(carry)}
    rows = pick(docs, doc_id=id_col, text=text_col, **more)
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("no_id"), *more)
    return rows.select("doc_id", "id0", F.xxhash64("no_id", "text").alias("mark"), "text", *more)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)


def _shard(window: int):
    """For one shard: repeated runs of starts of its contents, and for split hashes a digest for each class of starts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        contents = [bytes(x) for x in pdf["data"]]
        d1, d2, split = pdf["d1"].to_numpy(), pdf["d2"].to_numpy(), bool(pdf["split"].iloc[0])
        is_start, of, hit = repeated_starts(contents, window, pdf["n"].to_numpy())
        begin = np.cumsum([0, *map(len, contents)])
        lo, hi = _runs(hit)
        which = np.searchsorted(begin, lo, side="right") - 1
        out = [pd.DataFrame({"d1": d1[which], "d2": d2[which], "lo": lo - begin[which], "hi": hi - begin[which], "g1": 0, "g2": 0, "shard": pdf["shard"].iloc[0], "open": False})]
        if split:
            # One start of each class stands for it; the others of a repeated class are known already.
            at = np.flatnonzero(is_start)
            _, first = np.unique(of[at], return_index=True)
            at = at[first]
            text = np.frombuffer(b"".join(contents), dtype=np.uint8)
            g = [gram_hashes(text, window, seed)[at].view(np.int64) for seed in range(2)]
            which = np.searchsorted(begin, at, side="right") - 1
            out.append(pd.DataFrame({"d1": d1[which], "d2": d2[which], "lo": at - begin[which], "hi": at - begin[which] + 1, "g1": g[0], "g2": g[1], "shard": pdf["shard"].iloc[0], "open": True}))
        # A run never crosses two contents: a content's last bytes are no starts.
        return pd.concat(out, ignore_index=True)

    return run, "d1 long, d2 long, lo long, hi long, g1 long, g2 long, shard string, open boolean"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of digests: starts whose digest another shard has too, by binary search in its sorted digests."""
    pdf = pdf.sort_values(["shard", "g1", "g2"], kind="stable")
    g = np.empty(len(pdf), dtype=[("a", "<i8"), ("b", "<i8")])
    g["a"], g["b"] = pdf["g1"].to_numpy(), pdf["g2"].to_numpy()
    every = np.sort(g)
    hit = np.searchsorted(every, g, side="right") - np.searchsorted(every, g, side="left") >= 2  # a shard has a digest once
    return pdf.loc[hit, ["d1", "d2", "lo", "hi"]]


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte ranges covered by repeated strings: id0, mark (a document's key, see ``cut_repeats``), ranges array<struct<s, e>>, unmerged."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    scratch = Scratch(spark, "suffix")
    rows = _keyed(docs, id_col, text_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [h for text in pdf["text"] for h, _, _ in anchors(_bytes(text), window, gram)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.uint64), [])
            yield pd.DataFrame({"h": h.view(np.int64), "n": np.asarray(n, dtype=np.int64)})

    often = rows.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    often = scratch.keep(often.select("h"), "anchors")
    filter_ = spark.sparkContext.broadcast(build_filter(often, often.count()))

    def regions(batches):
        import pyarrow as pa

        seen: set[int] = set()  # a content's bytes are passed on once a task
        for batch in batches:
            at, hs, begins, sizes, one, two, data = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                b = _bytes(text)
                for h, begin, n in anchors(b, window, gram):
                    on = np.flatnonzero(filter_.value.has(h))
                    for hh, q, k in zip(h[on].view(np.int64).tolist(), begin[on].tolist(), n[on].tolist(), strict=True):
                        content = b[q : q + k - 1 + window].tobytes()
                        digest = xxhash.xxh3_128_intdigest(content, seed=hh & 0xFFFFFFFF)
                        pair, new = _pair(digest), digest not in seen
                        if new:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(digest)
                        at.append(i)
                        hs.append(hh)
                        begins.append(q)
                        sizes.append(k)
                        one.append(pair[0])
                        two.append(pair[1])
                        data.append(content if new else None)
            where = pa.array(at, pa.int64())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id0").take(where), batch.column("mark").take(where), long(hs), long(begins), long(sizes), long(one), long(two), pa.array(data, pa.binary())], names=["id0", "mark", "h", "q", "k", "d1", "d2", "data"])

    kind = rows.schema["id0"].dataType.simpleString()
    found = scratch.keep(rows.select("id0", "mark", "text").mapInArrow(regions, f"id0 {kind}, mark long, h long, q long, k long, d1 long, d2 long, data binary"), "regions")
    times = found.groupBy("h", "d1", "d2").agg(F.count("*").alias("n"))
    variants = times.groupBy("h").agg(F.count("*").alias("contents"), F.sum("n").alias("all")).where("all > 1")
    contents = found.where("data is not null").select("h", "d1", "d2", "data").dropDuplicates(["h", "d1", "d2"])
    contents = contents.join(times.join(variants, "h").drop("all"), ["h", "d1", "d2"])
    contents = scratch.keep(contents, "contents")
    total = contents.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    split = F.col("contents") > SPLIT
    part = F.pmod(F.xxhash64("d1", "d2"), F.ceil(F.col("contents") / SPLIT))
    name = F.when(split, F.concat_ws("/", F.lit("h"), F.col("h"), part)).otherwise(F.concat_ws("/", F.lit("n"), F.pmod(F.xxhash64("h"), F.lit(shards))))
    run, schema = _shard(window)
    dealt = contents.select("d1", "d2", "data", "n", split.alias("split"), name.alias("shard")).repartition(min(shards, MOST_TASKS), "shard")
    arrays = scratch.keep(dealt.groupBy("shard").applyInPandas(run, schema), "arrays")
    scratch.drop(contents)
    open_ = arrays.where("open")
    ranges = max(1, open_.count() // 100_000)
    merged = open_.withColumn("range", F.pmod(F.xxhash64("g1", "g2"), F.lit(ranges))).groupBy("range").applyInPandas(_merge, "d1 long, d2 long, lo long, hi long")
    hits = arrays.where("not open").select("d1", "d2", "lo", "hi").unionByName(merged)
    hits = hits.groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))
    hits = scratch.keep(hits, "hits")  # so that the join can be split where very many places have one content
    scratch.drop(arrays)
    placed = found.select("id0", "mark", "q", "d1", "d2").join(hits, ["d1", "d2"])
    placed = placed.select("id0", "mark", F.explode(F.transform("hits", lambda x: F.struct((F.col("q") + x["lo"]).alias("s"), (F.col("q") + x["hi"] - 1 + window).alias("e")))).alias("r"))
    return placed.groupBy("id0", "mark").agg(F.collect_set("r").alias("ranges"))


def merged_ranges(ranges: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and not touching ranges of the same bytes."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > end[:-1]])
    return np.stack([ranges[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1)


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Cut every byte covered by a ``window``-byte string that starts anywhere else too.

    Return doc_id, the columns named in ``carry`` as they are, n_bytes, n_removed,
    n_spans, kept_sha256 and, ``with_text``, kept (binary) and kept_text (without
    the parts of characters that a cut may leave), one row per input row.

    * overlapping occurrences count, also within one document; strings are
      judged on the input;
    * matches never cross documents; a null text is an empty one, and texts
      under ``window`` bytes have no such string;
    * rows alike in doc_id and text are occurrences of one another and are
      returned alike; null ids are documents like others;
    * cuts are of bytes, so a character may be cut in two.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession, 256)
    ranges = repeated_ranges(docs, window, gram, id_col, text_col)
    rows = _keyed(docs, id_col, text_col, carry).join(ranges, ["id0", "mark"], "left")
    same = ["doc_id", *(f"carry{i}" for i in range(len(carry)))]
    flat = rows.select(*same, "text", F.expr("flatten(transform(ranges, r -> array(r.s, r.e)))").alias("ranges"))
    made = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    if with_text:
        made |= {"kept": pa.binary(), "kept_text": pa.string()}

    def cut(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                spans = merged_ranges(np.array(ranges, dtype=np.int64).reshape(-1, 2)).tolist() if ranges else []
                at, kept = 0, []
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                row = (len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest())
                out.append((*row, left, left.decode("utf-8", "ignore")) if with_text else row)
            columns = zip(*out, strict=True) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), *(pa.array(c, k) for c, k in zip(columns, made.values(), strict=True))], names=[*same, *made])

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    schema = ", ".join([f"{c} {flat.schema[c].dataType.simpleString()}" for c in same] + [f"{n} {kinds[str(k)]}" for n, k in made.items()])
    return flat.mapInArrow(cut, schema).toDF("doc_id", *carry, *made)


def op5_suffix_shards(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), with_text=False)


#: Every 200-byte string of every distinct text, so memory for all of them: 11 s for 2.4 MB of texts.
OP5_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
t AS (SELECT b, octet_length(b) AS n, count(*) AS copies, row_number() OVER () AS id FROM d GROUP BY b),
w AS (SELECT id, p, copies, md5_number(b[p + 1:p + 200]) AS h FROM (SELECT id, b, copies, unnest(range(n - 199)) AS p FROM t WHERE n >= 200)),
r AS (SELECT h FROM w GROUP BY h HAVING sum(copies) > 1),
s AS (SELECT id, p, p - lag(p) OVER (PARTITION BY id ORDER BY p) AS gap FROM w SEMI JOIN r USING (h)),
g AS (SELECT id, p, count(*) FILTER (WHERE gap IS NULL OR gap > 200) OVER (PARTITION BY id ORDER BY p) AS span FROM s),
c AS (SELECT id, span, min(p) AS lo, max(p) + 200 AS hi FROM g GROUP BY id, span),
e AS (SELECT id, lo, hi FROM c UNION ALL SELECT id, n, n FROM t),
o AS (SELECT id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY id ORDER BY lo, hi), 0) AS before FROM e),
k AS (SELECT o.id, sum(hi - lo) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(hex(b)[2 * before + 1:2 * lo], '' ORDER BY lo, hi))) AS kept_sha256 FROM o JOIN t USING (id) GROUP BY o.id)
SELECT d.doc_id, t.n AS n_bytes, k.n_removed::BIGINT AS n_removed, k.n_spans, k.kept_sha256 FROM d JOIN t USING (b) JOIN k USING (id)
"""
