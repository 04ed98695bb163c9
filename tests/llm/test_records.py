"""WARC chunk tables, language masks, lookup sketches, the pipeline."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boardflow.llm import fingerprint as fp
from boardflow.llm import language_id
from boardflow.llm.common import Scratch
from boardflow.llm.language_id import grams_of, identify, make_filters, score_texts
from boardflow.llm.queries import QUERIES
from boardflow.llm.warc import read_chunks, write_archives
from tests.llm import data
from tests.llm.test_text import check_packing


def warc_rows(rows, min_bytes=0):
    least: dict = {}
    for page, html in rows:
        body = (html or "").encode()
        if page is not None:
            least[body] = min(page, least.get(body, page))
    out, seen = [], set()
    for page, html in rows:
        body = (html or "").encode()
        first = least.get(body) == page and (page, body) not in seen
        seen.add((page, body))
        response = first or len(body) < min_bytes
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else least.get(body)))
    return out


def test_archives_of_the_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{data.SF}/pages.parquet").collect()]
    data.same(QUERIES["op2_chunked_records"](spark, data.SF).collect(), warc_rows(rows))


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_archive_edge_cases(spark, min_bytes):
    big = "ünï" * 50_000
    rows = [(1, None), (2, ""), (3, "same"), (4, "same"), (5, "same"), (5, "same"), (6, big), (7, big + "x"), (8, "same payload, longer"), (9, "same payload, longer"), (None, "no id"), (10, "WARC/1.1\r\n\r\nin a payload")]
    pages = spark.createDataFrame([(p, None if p == 3 else f"http://x/{p} a", h, "y", 1) for p, h in rows], "page_id long, url string, html string, PAGE_ID string, row int")
    manifest = write_archives(pages, Scratch(spark, "warc"), chunk_bytes=1000, min_bytes=min_bytes)
    chunks = read_chunks(manifest, chunk_bytes=700).collect()
    assert max(len(r.data or b"") for r in chunks) <= 700
    last = [r for r in chunks if r["last"]]
    data.same([(r.page_id, r.declared_bytes, r.declared_digest, r.record_type, r.refers_to) for r in last], warc_rows(rows, min_bytes))
    payload: dict = {}
    for r in sorted((r for r in chunks if r.page_id == 6), key=lambda r: r.chunk_no):
        payload.setdefault(r.page_id, []).append(bytes(r.data))
        assert base64.b32encode(hashlib.sha1(b"".join(payload[6])).digest()).decode() == r.digest_so_far
    assert b"".join(payload[6]) == big.encode()


def test_a_payload_has_one_response_however_rows_are_spread(spark, tmp_path):
    """Repeated responses in six files, payloads beyond the broadcast limit, and a join that Spark turns into a local one."""
    big = ["".join(chr(97 + (i * k) % 26) for i in range(300_000)) for k in (1, 3, 5)]
    rows = [(p, big[p % 3]) for p in (1, 1, 2, 3, 4, 5, 6, 7)] + [(1, big[1]), (None, big[0]), (None, "alone"), (None, "alone"), (8, None), (8, None)]
    for part in range(6):
        df = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    wanted = warc_rows(rows * 6)
    for at_most in ("1m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at_most)
        try:
            manifest = write_archives(spark.read.parquet(str(tmp_path / "pages")), Scratch(spark, "warc"), chunk_bytes=100_000)
            last = read_chunks(manifest, data=False).where("last").collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        data.same([(r.page_id, r.declared_bytes, r.declared_digest, r.record_type, r.refers_to) for r in last], wanted)
        responses = [(r.page_id, r.declared_digest) for r in last if r.record_type == "response"]
        assert len({d for _, d in responses if _ is not None}) == len([d for _, d in responses if _ is not None])


def test_archives_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_chunks(write_archives(none, Scratch(spark, "warc"))).collect() == []


def test_a_broken_payload_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    manifest = write_archives(pages, Scratch(spark, "warc"))
    short = manifest.withColumn("length", F.col("length") - 20)
    with pytest.raises(Exception, match="within a record|isn't as long|incomplete|digest"):
        read_chunks(short).collect()


def test_masks_have_no_false_negative():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32)
    lang = rng.integers(0, 3, 4000)
    filters = make_filters(["a", "b", "c"], lang, grams)
    masks = filters.masks(grams)
    assert (((masks >> lang.astype(np.uint64)) & np.uint64(1)) == 1).all()
    other = rng.integers(0, 2**32, 200_000, dtype=np.uint64).astype(np.uint32)
    hits = np.array([((filters.masks(other) >> np.uint64(i)) & np.uint64(1)).mean() for i in range(3)])
    assert (hits < filters.rates * 2 + 1e-3).all()


@pytest.mark.parametrize("blank_known", [True, False])
def test_scores_are_counts_of_known_grams(blank_known):
    known = {"a": "the quick brown fox ", "b": "der schnelle braune "}
    grams = [grams_of([t])[0] for t in known.values()]
    grams = grams if blank_known else [g[g != 0x20202020] for g in grams]
    filters = make_filters(list(known), np.repeat([0, 1], list(map(len, grams))), np.concatenate(grams))
    texts = ["quick fox", "der braune schnelle der", "1234 !!"]
    hits, letters = score_texts(filters, texts)
    sets = [set(grams_of([t])[0].tolist()) for t in known.values()]
    for i, t in enumerate(texts):
        own = grams_of([t])[0].tolist()
        assert letters[i] == sum(g != 0x20202020 for g in own)
        for k, s in enumerate(sets):
            assert hits[i, k] == pytest.approx(sum(g in s for g in own if g != 0x20202020), abs=0.1)


def test_held_out_accuracy(spark):
    docs = data.documents(spark, "/root/testdata/sf0.01")
    found = {r.doc_id: r for r in identify(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    right = []
    for r in rows:
        p = found[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= p.score <= 1
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert p.lang_pred == "und"
        elif p.held_out and r.lang is not None:
            right.append(p.lang_pred == r.lang)
    assert len(right) > 100 and np.mean(right) >= 0.97


def test_masks_hold_every_language_of_an_n_gram(spark):
    """The fitted filters are those of a plain count over all rows: no n-gram and no language is left out."""
    rows = [(r.doc_id, r.text, r.lang) for r in data.documents(spark).collect() if r.text and r.lang]
    own: dict = {}
    for _, text, lang in rows:
        own.setdefault(lang, set()).update(g for g in grams_of([text])[0].tolist() if g != 0x20202020)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.col("doc_id").cast("string"))
    filters = language_id.fit(docs)
    assert set(filters.langs) == set(own)
    for i, lang in enumerate(filters.langs):
        every = np.array(sorted(set().union(*own.values())), dtype=np.uint32)
        has = ((filters.masks(every) >> np.uint64(i)) & np.uint64(1)).astype(bool)
        assert has[np.isin(every, list(own[lang]))].all()
        assert has[~np.isin(every, list(own[lang]))].mean() <= 2 * filters.rates[i] + 0.01


def test_ties_go_to_the_language_with_most_rows(spark):
    rows = [(i, "alpha beta gamma", "b") for i in range(6)] + [(10 + i, "alpha beta gamma", "a") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.col("doc_id").cast("string"))
    found = language_id.predict(docs, language_id.fit(docs), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("b", 0.5)}


def test_more_labels_than_bits_of_a_word(spark):
    rng = np.random.default_rng(8)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for _ in range(130)]
    rows = [(130 * d + k, " ".join(rng.permutation(w).tolist()), f"l{k:03}") for k, w in enumerate(words) for d in range(8 if k < 129 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in identify(docs).collect()}
    assert found == {d: lang for d, _, lang in rows}


def test_held_out_labels_are_never_used(spark):
    docs = data.documents(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    data.same(identify(docs).collect(), identify(other).collect())


def test_language_edge_cases(spark):
    found = identify(data.edge_docs(spark)).collect()
    assert len(found) == len(data.TEXTS)
    assert {r.lang_pred for r in found} <= {"en", "und"}
    assert all(r.lang_pred == "und" for r in found if r.doc_id in (1, 2, 3, 16))
    assert identify(data.no_docs(spark)).collect() == []
    unlabelled = data.edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}


def chain_rows(rows):
    """Rows (doc_id, text) with distinct ids: doc_id, n_chars, sha of the edited text, edited, next text."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        take = len(text) // 3
        edited = text[: len(text) - take] + after[:take]
        out.append((doc_id, text, edited, after))
    return out


def cut_of(text, run):
    """Runs of 16 units of 12 code points at most of each line; blanks at the ends don't count. Or runs of some code points."""
    return set(re.findall(rf"\S{{1,{run}}}", text)) if run else {m.rstrip(" \t\x0b\f\r") for m in re.findall(r"(?:[^ \t\n\x0b\f\r]{1,12}[ \t\x0b\f\r]*){1,16}", text)}


def likeness(a, b):
    run = 0
    for most, r in fp.FINER:
        run = r if max(len(a), len(b)) < most else run
    return alike(cut_of(a, run), cut_of(b, run))


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check_fingerprints(found, rows):
    found = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    prints = {}
    for doc_id, text, edited, after in chain_rows(rows):
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(text, edited))
        assert r.near_next == pytest.approx(likeness(text, after))
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, f) == f


def test_fingerprints_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in data.documents(spark).collect()]
    check_fingerprints(QUERIES["op6_lookup_sketches"](spark, data.SF).collect(), rows)


def test_fingerprint_edge_cases(spark):
    rows = [(k, t) for k, t in data.TEXTS if k is not None and k != 8]
    check_fingerprints(fp.compare_edited(data.edge_docs(spark, rows)).collect(), rows)
    # Null ids come last, by their texts' hashes; repeated rows are returned alike; rows of one id with other texts follow one another.
    found = fp.compare_edited(data.edge_docs(spark)).collect()
    assert len(found) == len(data.TEXTS)
    own = {17: "<|endoftext|> specials <pad> inside", 16: "\n\n\n"}
    last = next(r for r in found if r.doc_id == 17)
    assert last.edited_sha256 == hashlib.sha256((own[17][: len(own[17]) - len(own[17]) // 3] + own[16]).encode()).hexdigest()
    nulls = [r for r in found if r.doc_id is None]
    assert sorted(r.n_chars for r in nulls) == [0, 80] and {r.near_edited for r in nulls if r.n_chars == 0} == {1.0}
    twice = [tuple(r) for r in found if r.doc_id == 8]
    assert len(twice) == 2 and twice[0] == twice[1]
    shared = spark.createDataFrame([(1, "one text here"), (1, "another text there"), (0, "last")], "doc_id long, text string")
    found = fp.compare_edited(shared).collect()
    assert len(found) == 3 and len({r.fingerprint for r in found}) == 3 and sorted(r.next_doc_id for r in found) == [0, 1, 1]
    assert fp.compare_edited(data.no_docs(spark)).collect() == []
    assert fp.compare_edited(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).first().near_next == 1.0


def test_texts_of_one_paragraph_are_like_their_edited_ones(spark):
    rng = np.random.default_rng(9)
    letters = lambda low, n: "".join(chr(low + int(i)) for i in rng.integers(0, 3000, n))
    texts = ["a few words of text stay", "abc", "Boardflow", letters(0x4E00, 90), letters(0xAC00, 5000), letters(0x3400, 70_000), "\U0001f43c\U0001f40d" * 9, " ".join(f"w{i}" for i in range(1500))]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in fp.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    check_fingerprints(found.values(), rows)
    for doc_id, text, _, _ in chain_rows(rows):
        assert found[doc_id].near_edited > 0.15 and found[doc_id].near_edited > found[doc_id].near_next, text[:20]


def test_many_paragraphs_take_seconds(spark):
    rows = [(i, "\n".join(f"line {i * 15_000 + k}" for k in range(30_000))) for i in range(2)]
    check_fingerprints(fp.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_peeling_recovers_the_difference(spark):
    a, b = [f"p{i}" for i in range(40)], [f"p{i}" for i in range(4, 45)]
    rows = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string")
    rows = rows.select(F.expr(fp.digests_sql("a")).alias("a"), F.expr(fp.digests_sql("b")).alias("b"))
    sub = "8"
    one = rows.select(F.expr(fp.peel_sql(fp.cells_sql("a", sub), fp.cells_sql("b", sub), sub)).alias("d"), F.expr(fp.likeness_sql("a", "b", fp.cells_sql("a", sub), fp.cells_sql("b", sub))).alias("l")).first()
    assert one.d in (9, None) and one.l == pytest.approx(36 / 45)


def test_pipeline_against_brute_force(spark):
    """From the documents that the first stage keeps, the others are done in plain Python."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    docs = data.documents(spark)
    first = corpus_pipeline.language_id(spark, docs, data.SF)
    assert first.columns == corpus_pipeline.COLUMNS
    kept = first.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    labelled = [r.doc_id for r in docs.collect() if r.text and len(r.text) > 200]
    assert len({r.doc_id for r in kept} & set(labelled)) >= 0.95 * len(labelled)
    assert all(texts[r.doc_id] == r.text and re.search(r"[^\W\d_]", r.text) for r in kept)
    rows = [(d, t) for d, *_, t in data.line_dedup_rows([(r.doc_id, r.text) for r in kept])]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, data.jaccard_classes(rows, 5, 80), strict=True) if c == d]
    raw = [(t or "").encode() for _, t in rows]
    left = [data.cut(t, s).decode("utf-8", "ignore") for t, s in zip(raw, data.covered_spans(raw, 200), strict=True)]
    check_packing([(d, t) for (d, _), t in zip(rows, left, strict=True)], corpus_pipeline.run(spark, data.SF).collect(), 0.02)


def test_pipeline_edge_cases(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, data.no_docs(spark), data.SF).collect() == []
        stage(spark, data.edge_docs(spark), data.SF).collect()


def test_near_dedup_keeps_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [
        (5, text("a")), (5, text("b")),  # one id, unrelated texts: both stay
        (1, text("c")), (6, text("c")), (6, text("d")),  # of id 6 only the copy of 1 goes
        (7, ""), (7, ""), (7, text("e")), (7, text("e")),  # rows without words stay, of equal rows one
        (2, text("f")), (None, text("f")), (None, text("g")), (None, text("h")), (None, text("h")), (None, text("h") + " more"), (None, None), (None, None),
    ]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", len(t or "")) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_dedup(spark, docs, data.SF)
    assert found.columns == corpus_pipeline.COLUMNS
    found = [(r.doc_id, r.text) for r in found.collect()]
    third = [r for r in found if r[0] is None and r[1] and r[1].startswith("h0 ")]
    assert len(third) == 1
    want = [(5, text("a")), (5, text("b")), (1, text("c")), (6, text("d")), (7, ""), (7, ""), (7, text("e")), (2, text("f")), (None, text("g")), *third, (None, None), (None, None)]
    data.same(found, want)
