"""Jaccard join, metric range join, components."""

from __future__ import annotations

import numpy as np
import pytest

from boardflow.llm.common import Scratch
from boardflow.llm.components import connected_components
from boardflow.llm.embedding_dedup import near_duplicates
from boardflow.llm.jaccard_join import link, op1_grouped_prefixes, parity_fold
from tests.llm import data


def test_join_finds_what_brute_force_finds(spark):
    rows = [(r.doc_id, r.text) for r in data.documents(spark).collect()]
    data.same(op1_grouped_prefixes(spark, data.SF).collect(), data.jaccard_classes(rows, 4, 85))


def test_join_edge_cases(spark):
    docs = data.edge_docs(spark)
    data.same(link(docs).collect(), data.jaccard_classes(data.TEXTS, 5, 80))


def test_join_with_a_hot_group_and_a_chain(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in rng.integers(0, 500, 120)]
    rows, words = [], list(base)
    for i in range(40):  # each differs a little from the one before: a chain
        words[i * 3] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base)) for i in range(60)]
    rows += [(3000 + i, "same first words here " + " ".join(f"u{i}_{k}" for k in range(50))) for i in range(60)]
    data.same(link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect(), data.jaccard_classes(rows, 4, 85))


@pytest.mark.parametrize("size", [1, 40, 600, 5000])
def test_join_bits_differ_at_most_as_sets_do(size):
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    for kept in (0, size // 2, size - 1, size):
        b = np.unique(np.concatenate([a[:kept], rng.integers(0, 2**64, size // 3 + 1, dtype=np.uint64)]))
        odd = sum((x ^ y).bit_count() for x, y in zip((v & (2**64 - 1) for v in parity_fold(a)), (v & (2**64 - 1) for v in parity_fold(b)), strict=True))
        apart = len(np.setxor1d(a, b))
        assert odd <= apart and (odd - apart) % 2 == 0
    assert parity_fold(a) == parity_fold(a[::-1])


def test_join_of_nothing(spark):
    assert link(data.no_docs(spark)).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (8, 9), (3, 7)], "a long, b long")
    found = {(r.node, r.component) for r in connected_components(links, Scratch(spark, "t")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 8), (9, 8)}


def brute_vectors(rows, threshold):
    good = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(i)
    pairs = []
    for k, a in enumerate(good):
        for b in good[k + 1 :]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold or (x == y).all():
                    pairs.append((a, b))
    n = [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    root = data.components(len(rows), pairs)
    least: dict = {}
    for i in good:
        known = [x for x in (least.get(root[i]), rows[i][0]) if x is not None]  # a null id is never the smallest
        least[root[i]] = min(known, default=None)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        comp = least[root[i]] if i in set(good) else vec_id
        out.append((vec_id, n[i], comp, vec_id == comp))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_brute_force(spark, block):
    table = spark.read.parquet(f"{data.SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    data.same(near_duplicates(table, block=block).collect(), brute_vectors(rows, 0.98))


def test_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1),
        (13, [-1.0, 0.0], 1), (None, [0.0, 3.0], 7), (None, [0.0, 4.0], 7), (None, None, 7), (14, [1e-30, 0.0], 1), (15, [0.0, 1e20], 1), (16, [-0.0, 1.0], 1),
    ]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, VEC_ID string, v int")
    data.same(near_duplicates(table).collect(), brute_vectors([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows], 0.98))


def test_vectors_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_many_cells_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 6))
    rows = [(i, [float(x) for x in (base[i % 40] + rng.normal(size=6) * 0.08).astype(np.float32)], 0) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    data.same(near_duplicates(table, pivots=20, block=20).collect(), brute_vectors(rows, 0.98))
