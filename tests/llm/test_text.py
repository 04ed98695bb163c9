"""Suffix arrays, lines, BPE, packing, sharding."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from pyspark.sql import functions as F

from boardflow.llm import byte_bpe, packing, suffix_dedup
from boardflow.llm.line_dedup import dedup_lines
from boardflow.llm.packing import pack_documents
from boardflow.llm.queries import ORACLE_SQL, QUERIES
from boardflow.llm.sharding import assign_shards, shuffle_key
from boardflow.llm.suffix_dedup import cut_repeats
from tests.llm import data


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (7, 1), (50, 2), (300, 3), (400, 256)):
        text = rng.integers(0, k, n).astype(np.uint8)
        raw = text.tobytes()
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(text, sa)
        for j in range(1, n):
            a, b = raw[sa[j - 1] :], raw[sa[j] :]
            want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[j] == want
    assert len(suffix_dedup.suffix_array(np.zeros(0, dtype=np.uint8))) == 0


def test_common_prefixes_after_different_bytes(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("0123456789") for _ in range(230))
    for pair in (("b", "a"), ("a", "b")):
        contents = [(x + passage).encode() for x in pair]
        is_start, of, hit = suffix_dedup.repeated_starts(contents, 200)
        assert np.flatnonzero(hit).tolist() == [*range(1, 32), *range(232, 263)]
        assert (of[1:32] == of[232:263]).all()
        text = np.frombuffer(b"".join(contents), dtype=np.uint8)
        sa = suffix_dedup.suffix_array(text)
        lcp = suffix_dedup.common_prefixes(text, sa)
        assert lcp[1:].tolist() == [len(os.path.commonprefix([text[a:].tobytes(), text[b:].tobytes()])) for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True)]
        rows = [(i, x + passage) for i, x in enumerate(pair)]
        data.same(removed(cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"))), data.suffix_rows(rows, 200))


def removed(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def test_repeats_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in data.documents(spark).collect()]
    data.same(QUERIES["op5_suffix_shards"](spark, data.SF).collect(), data.suffix_rows(rows, 200))


def test_repeats_edge_cases(spark):
    data.same(removed(cut_repeats(data.edge_docs(spark))), data.suffix_rows(data.TEXTS, 200))
    assert cut_repeats(data.no_docs(spark)).collect() == []


def test_repeats_with_split_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(200 + i, "fixed passage of text " + str(i % 7) + " goes on and on") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    data.same(removed(cut_repeats(docs, window=12, gram=5)), data.suffix_rows(rows, 12))


def test_lines_against_sql_and_brute_force(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data.SF}/documents.parquet'")
    found = QUERIES["op10_line_windows"](spark, data.SF)
    names = sorted(found.columns)
    data.same(found.select(*names).collect(), con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op10_line_windows']})").fetchall())
    rows = [(r.doc_id, r.text) for r in data.documents(spark).collect()]
    data.same(dedup_lines(data.documents(spark)).select("doc_id", "n_lines", "n_removed", "n_spans", "text").collect(), data.line_dedup_rows(rows))


def test_lines_edge_cases(spark):
    rows = [(k, t) for k, t in data.TEXTS if k is not None and k != 8]
    docs = data.edge_docs(spark, rows)
    data.same(dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_spans", "text").collect(), data.line_dedup_rows(rows))
    assert dedup_lines(data.no_docs(spark)).collect() == []
    every = dedup_lines(data.edge_docs(spark), carry=("lang",))
    assert every.count() == len(data.TEXTS)
    repeated = [(r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame([(1, "p\nq\nr")] * 2 + [(None, "p\nq\nr")], "doc_id long, text string")).collect()]
    assert sorted(repeated) == [(0, "p\nq\nr"), (3, ""), (3, "")]


def encoder():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_as_tiktoken(spark):
    rows = [(r.doc_id, r.text) for r in data.documents(spark).collect()] + data.TEXTS
    rows += [(900 + i, t) for i, t in enumerate(["aaaa" * 400, "\u0000\u0001", "ab" * 3000, "日本語のテキスト" * 40, " \n\n\t x", "'s 'LL 12345678"])]
    docs = data.edge_docs(spark, rows)
    enc = encoder()
    want = []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    files = byte_bpe.default_files()
    data.same(byte_bpe.digest_documents(docs, *files).collect(), want)
    encoded = byte_bpe.encode_documents(docs, *files)
    back = byte_bpe.decode_documents(encoded, *files)
    data.same([(r.doc_id, bytes(r.data).decode()) for r in back.collect()], [(d, t or "") for d, t in rows])
    assert byte_bpe.digest_documents(data.no_docs(spark), *files).collect() == []


def check_packing(rows, found, slack):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = [], 0
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(doc_id, i, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    data.same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], want)
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-total // 1024) * (1 + slack) + 1


def test_packing(spark):
    rows = [(r.doc_id, r.text) for r in data.documents(spark).collect()]
    check_packing(rows, QUERIES["op4_pattern_packing"](spark, data.SF).collect(), 0.01)


def test_packing_edge_cases(spark):
    check_packing(data.TEXTS, pack_documents(data.edge_docs(spark)).collect(), 0.1)
    assert pack_documents(data.no_docs(spark)).collect() == []


def test_packing_plans_use_each_piece_once():
    rng = np.random.default_rng(4)
    for _ in range(20):
        hist = np.zeros(65, dtype=np.int64)
        for n in rng.integers(1, 65, rng.integers(1, 60)):
            hist[n] += int(rng.integers(1, 40))
        left = hist.copy()
        for inside, bins in packing.make_plan(hist, 64):
            assert sum(n * times for n, times in inside) <= 64
            for n, times in inside:
                left[n] -= times * bins
        assert not left.any()


def check_shards(found, shards):
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(found)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return by


def test_shards_carry_the_mixture(spark):
    docs = data.documents(spark)
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    found = assign_shards(docs, cell_rows=20).collect()
    data.same([(r.doc_id, r.size, r.text_crc32) for r in found], want)
    by = check_shards(found, 16)
    of = defaultdict(int)
    for r in found:
        of[r.source] += 1
    for rows in by.values():
        for source, n in of.items():
            assert abs(sum(r.source == source for r in rows) - n / 16) <= 2
    one = assign_shards(docs, cell_rows=10**6).collect()
    data.same([(r.doc_id, r.shard, r.slot) for r in one], [(r.doc_id, r.shard, r.slot) for r in found])


def shard_rows(rows, shards, seed=42):
    """rows: (doc_id, text, source)."""
    strata = defaultdict(list)
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        crc = zlib.crc32(raw)
        key = int(hashlib.md5(f"{'null' if doc_id is None else doc_id}:{seed}:{crc}:{len(raw)}".encode()).hexdigest()[:15], 16)
        strata["0" if source is None else "1" + source].append((key, doc_id is not None, doc_id or 0, crc, len(raw) + 1))
    order = sorted(((2 * r - 1) / (2 * len(of)), row[0], stratum, *row[1:]) for stratum, of in strata.items() for r, row in enumerate(sorted(of), 1))
    out = []
    for place, (_, _, _, has, doc_id, crc, size) in enumerate(order):
        shard = ((place + 1) * shards - 1) // len(order)
        out.append((doc_id if has else None, size, crc, shard, place - shard * len(order) // shards))
    return out


@pytest.mark.parametrize("cell_rows", [3, 40, 10**6])
def test_shards_are_those_of_one_sort(spark, cell_rows):
    rows = [(r.doc_id, r.text, r.source) for r in data.documents(spark).collect()]
    rows += [(None, f"text {i % 50}", "hot") for i in range(150)] + [(7, None, None), (7, "", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = assign_shards(docs, cell_rows=cell_rows)
    data.same(found.select("doc_id", "size", "text_crc32", "shard", "slot").collect(), shard_rows(rows, 16))


def test_rows_without_an_id_are_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    keys = docs.select(F.shiftright(shuffle_key(F.col("doc_id"), 42, F.crc32(F.col("text").cast("binary"))), 55).alias("cell"))
    assert keys.groupBy("cell").count().agg(F.max("count")).first()[0] < 400


def test_shards_edge_cases(spark):
    found = assign_shards(data.edge_docs(spark), cell_rows=3).collect()
    check_shards(found, 16)
    assert len(found) == len(data.TEXTS)
    check_shards(assign_shards(data.edge_docs(spark, data.TEXTS[:5])).collect(), 16)
    assert assign_shards(data.no_docs(spark)).collect() == []
