"""Pieces, prefix tries and fill-in-the-middle against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from boardflow.llm import fill_middle, prefix_trie, sentence_pieces
from boardflow.llm.queries import QUERIES
from tests.llm import data


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


# --- pieces -------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(sentence_pieces.default_file())


def piece_rows(pieces, rows):
    out = []
    for doc_id, text in rows:
        ids = pieces.library.encode(text or "", add_bos=True, add_eos=True)
        out.append((doc_id, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(pieces.library.decode(ids).encode())))
    return out


def test_pieces_of_the_table(spark, pieces):
    rows = [(r.doc_id, r.text) for r in data.documents(spark).collect()]
    data.same(QUERIES["op11_backtracked_pieces"](spark, data.SF).collect(), piece_rows(pieces, rows))


def test_pieces_of_edge_rows(spark, pieces):
    found = sentence_pieces.digest_documents(data.edge_docs(spark), sentence_pieces.default_file())
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    data.same(found.collect(), piece_rows(pieces, data.TEXTS))
    assert sentence_pieces.digest_documents(data.no_docs(spark), sentence_pieces.default_file()).collect() == []


def test_ids_and_texts_come_back(spark):
    rows = [(i, t, "x") for i, t in data.TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = sentence_pieces.encode_documents(docs, sentence_pieces.default_file())
    data.same(sentence_pieces.decode_documents(encoded, sentence_pieces.default_file()).collect(), [(i, t or "") for i, t in data.TEXTS])


def test_hard_texts_are_encoded_as_by_the_library(pieces):
    rng = random.Random(11)
    names = list(pieces.ids)
    texts = ["".join(rng.choice(names) for _ in range(rng.randint(1, 25))).replace("▁", " ") for _ in range(3000)]
    texts += ["".join(rng.choice("ab eo▁ \n\t\0é🐼中<s>x") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0xE000, 0xFFFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    texts += ["", " ", "▁", "a" * 20_001, " " * 3001 + "x", "the" * 3000, "中文" * 2000, "<s> </s> <unk> <0x41>"]
    assert pieces.encode(texts) == pieces.library.encode(texts, add_bos=True, add_eos=True)


def test_search_goes_back(pieces):
    """Longest matches alone aren't the encoding; and what is remembered doesn't change it."""
    text = "▁the"
    greedy = [w for w in ("▁thereof", "▁undesired", "▁abase", "▁misuses", "▁unhelpful", "▁coexist") if len(longest_first(pieces, w)) != len(pieces.merge(w))]
    assert greedy, "no word needs to go back"
    for w in [text, *greedy]:
        assert pieces.search(pieces.longest(w), 0, len(w)) == pieces.merge(w)


def longest_first(pieces, word):
    best, at, out = pieces.longest(word), 0, []
    while at < len(word):
        out.append(best[at])
        at += pieces.size[best[at]]
    return out


def test_forgetting_changes_nothing(pieces, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MOST_WORDS", 3)
    monkeypatch.setattr(sentence_pieces, "MOST_PAIRS", 2)
    texts = ["some words of a text", "and some of another text", "some words"] * 3
    assert [pieces.encode([t])[0] for t in texts] == pieces.library.encode(texts, add_bos=True, add_eos=True)


# --- prefix tries -------------------------------------------------------------


def trie_rows(rows, family=5, most=9):
    """rows: (conv_id, turn, role, text)."""
    by: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}".encode()), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in by.items()}
    members: dict = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        made = tuple(own.get(c - int(math.fmod(c, family)), [])[:h]) + tuple(turns[h:])  # a remainder has the sign of the id
        for d in range(len(made) + 1):
            members.setdefault(made[:d], []).append((c, len(made)))
    kids: dict = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []
    for node, of in members.items():
        leaves = saved = 0
        todo = [node]
        while todo:
            x = todo.pop()
            todo += kids.get(x, [])
            leaves += x not in kids
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
        ends = ",".join(str(c) for c, n in sorted(of) if n == len(node))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in of), len(node), parent, len(of), len(kids.get(node, [])), leaves, saved, sha(ends.encode())))
    return out


def conversations(seed, n=300, talk="abcd"):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice([*talk, None, "", "ü" * 5])))
    return rows


CONV = "conv_id long, turn long, role string, text string, TEXT string, depth int"


def as_table(spark, rows):
    return spark.createDataFrame([(*r, "other", 1) for r in rows], CONV)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    data.same(QUERIES["op12_merged_prefixes"](spark, "/root/testdata/sf0.01").collect(), trie_rows(rows))


@pytest.mark.parametrize("segment", [3, 40, 100_000])
def test_trie_whatever_the_cuts(spark, monkeypatch, segment):
    """Segments of a few turns, groups of three of them, runs that all go to files."""
    monkeypatch.setattr(prefix_trie, "FAN", 3)
    rows = conversations(3)
    rows += [(1000 + c, t, "user", "always the same") for c in range(200) for t in range(20)]  # copies
    data.same(prefix_trie.prefix_trie(as_table(spark, rows), segment_turns=segment, memory=1000).collect(), trie_rows(rows))


def test_trie_of_edge_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "first"), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, 1, "user", "w")]
    rows += [(5, 0, "user", "y" * 100_000), (-3, 0, "a", "b"), (10, 2, "user", "y"), (10, 1, "use", "ry"), (12, 0, "user", "y"), (2**40, 0, "us", "ery")]
    data.same(prefix_trie.prefix_trie(as_table(spark, rows)).collect(), trie_rows(rows))
    assert prefix_trie.prefix_trie(as_table(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(as_table(spark, rows[:1])).collect() == []


def test_a_long_conversation(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(5000)] + [(1, t, "user", f"turn {t}") for t in range(5000)] + [(2, 0, "user", "turn 0")]
    found = prefix_trie.prefix_trie(as_table(spark, rows), segment_turns=2000).agg(F.count("*"), F.max("depth"), F.sum("n_leaves")).first()
    want = trie_sums(rows)
    assert tuple(found) == want


def trie_sums(rows):
    own: dict = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((r, x))
    nodes: dict = {}
    made = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made.append([*own[0][:h], *turns[h:]])
    for m in made:
        node = nodes
        for t in m:
            node = node.setdefault(t, {})
    count = deepest = total = 0
    todo, order = [(nodes, 0)], []
    while todo:
        node, d = todo.pop()
        order.append((node, d))
        todo += [(k, d + 1) for k in node.values()]
    leaves: dict = {}
    for node, d in reversed(order):
        leaves[id(node)] = sum(leaves[id(k)] for k in node.values()) or 1
        count, deepest, total = count + 1, max(deepest, d), total + leaves[id(node)]
    return count, deepest, total


def test_merge_carries_shared_turns():
    rng = random.Random(4)
    records = [(b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(12))), [], 1, i, "") for i in range(500)]
    for k in (1, 2, 3, 7, 16):
        found = list(prefix_trie.merge(iter(prefix_trie.sorted_run(records[i::k])) for i in range(k)))
        assert [r[0] for _, r in found] == sorted(r[0] for r in records)
        assert [n for n, _ in found] == [0, *(prefix_trie.shared_turns(a[1][0], b[1][0]) for a, b in zip(found, found[1:], strict=False))]
    assert list(prefix_trie.merge([])) == []


def test_runs_in_files_are_removed():
    records = [(bytes([i % 7]) * 16, [1], 1, i, "") for i in range(100)]
    runs = prefix_trie.Runs(memory=500, block=3)
    for i in range(0, 100, 10):
        runs.add(records[i : i + 10])
    folder = runs.folder.name
    assert [r[0] for _, r in runs.merged()] == sorted(r[0] for r in records)
    assert not os.path.exists(folder)


# --- fill in the middle -------------------------------------------------------


def fim_row(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, sha(text.encode()), sha(text.encode())
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(tokens), "spm" if h[3] % 100 < 80 else "psm", len(p), len(m), sha(out.encode()), sha(text.encode())


def fim(df):
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_middle.fill_in_middle(df)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")), digest(fill_middle.restore(F.col("output"), F.col("form")))).collect()


def test_cuts_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in data.documents(spark, "/root/testdata/sf0.01").collect()]
    found = QUERIES["op13_isolated_split"](spark, "/root/testdata/sf0.01")
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    found = found.collect()
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    data.same(found, [fim_row(*r) for r in rows])


def test_cuts_of_edge_rows(spark):
    rng = random.Random(6)
    rows = data.TEXTS + [(100 + i, "".join(rng.choice("ab <>PSM\n\t🐼é　\x0b\x85") for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [(2000 + i, t) for i in range(12) for t in ("a <P> b", "<S>", "x<M>", "<<S>", "<P", "S>", "< P>", " \n ")]
    data.same(fim(data.edge_docs(spark, rows)), [fim_row(*r) for r in rows])
    assert fim(data.no_docs(spark)) == []


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_give_the_same_ends(block):
    rng = random.Random(8)
    for text in ["", "x" * 3000, " " * 3000, *("".join(rng.choice("ab  \n🐼") for _ in range(400)) for _ in range(20))]:
        want = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
        assert fill_middle.token_ends(text, block=block).tolist() == want
