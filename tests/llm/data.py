"""Small fixtures and plain Python versions to hold the operators against."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, n string, lines int, mark string"

_rng = random.Random(5)
_WORDS = [f"w{i}" for i in range(60)]
_LONG = " ".join(_rng.choice(_WORDS) for _ in range(6000))
_BASE = [_rng.choice(_WORDS) for _ in range(80)]
_NEAR = [*_BASE[:40], "changed", *_BASE[41:]]
_LINES = "one line here\nsecond line here\nthird line here\nfourth line here"

TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "short text"),
    (5, "Short TEXT"),
    (6, " ".join(_BASE)),
    (7, " ".join(_NEAR)),
    (8, " ".join(_BASE)),
    (8, " ".join(_BASE)),
    (9, _LONG),
    (10, _LONG + " tail"),
    (11, _LINES),
    (12, "intro\n" + _LINES + "\noutro"),
    (13, "a\na\na\na\na"),
    (14, "Ünïcödé ßtraße 🐼 " * 30),
    (15, "x" * 700),
    (None, "a row without an id " * 4),
    (None, None),
    (16, "\n\n\n"),
    (17, "<|endoftext|> specials <pad> inside"),
]


def edge_rows(texts=None):
    """Rows with nulls in every column, ties, repeats, empty and very long texts, and extra columns with clashing names."""
    out = []
    for i, (doc_id, text) in enumerate(texts or TEXTS):
        out.append((doc_id, text, None if i % 3 == 0 else "en", None if i % 4 == 0 else "web", None if text is None else len(text), "other", None, i, "m"))
    return out


def edge_docs(spark, texts=None):
    return spark.createDataFrame(edge_rows(texts), DOC_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_classes(rows, words, percent):
    """rows: (doc_id, text). Return (doc_id, n, component) of each."""
    sets = [shingles(t, words) for _, t in rows]
    by: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen, pairs = set(), []
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    same = len(sets[a] & sets[b])
                    if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                        pairs.append((a, b))
    root = components(len(rows), pairs)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(doc_id, least.get(root[i], doc_id))
    return [(doc_id, len(sets[i]), least.get(root[i]) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def covered_spans(texts, window):
    """Maximal removed byte runs of each text (bytes)."""
    count = Counter(hash(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - window + 1):
            if count[hash(t[i : i + window])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
        out.append(spans)
    return out


def cut(text, spans):
    at, kept = 0, []
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


def suffix_rows(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), t, spans in zip(rows, raw, covered_spans(raw, window), strict=True):
        left = cut(t, spans)
        out.append((doc_id, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out


def line_dedup_rows(rows):
    """rows: (doc_id, text), distinct ids. Return doc_id, n_lines, n_removed, n_spans, text."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out.append((doc_id, 0, 0, 0, None))
            continue
        lines = text.split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone[i : i + 3] = [True] * 3
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(lines), sum(gone), spans, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in row)


def same(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)
