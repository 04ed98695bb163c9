"""Scans in blocks, greedy leaders, motion picks and medians against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardflow.operators import clean, leaders, sampling, scans
from boardflow.operators.ranks import fill_ranks
from tests.test_alike import likeness, made


@pytest.fixture
def many_blocks(spark):
    """Small blocks would be put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def lists(seed, n=400):
    """One list with most of the rows, short ones, one without a name; values and ranks with nulls and ties."""
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(n), n):
        by = rng.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((by, i, rng.choice([None, rng.randint(0, 9), rng.randint(0, 9)]), rng.choice([None, None, 0, -2, rng.randint(1, n)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "by string, t long, v long, r int")


def by_list(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_running_values(spark, many_blocks, n):
    rows = lists(1, n)
    df = frame(spark, rows)
    want_sum, want_place, want_last, want_rank = {}, {}, {}, {}
    for own in by_list(rows).values():
        total, last, top = None, None, 0
        for k, (_, t, v, r) in enumerate(own, 1):
            total = total if v is None else (total or 0) + v
            want_sum[t], want_place[t], want_last[t] = total, k, last
            last = v
            want_rank[t] = r if r is not None and r > 0 else top + 1
            top = max(top, want_rank[t])
    assert {r.t: r.o for r in scans.running_sum(df, ["by"], ["t"], F.col("v"), "o").collect()} == want_sum
    assert {r.t: r.o for r in scans.place_in(df, ["by"], ["t"], "o").collect()} == want_place
    assert {r.t: r.o for r in scans.previous(df, ["by"], ["t"], "v", "o").collect()} == want_last
    assert {r.t: r.o for r in fill_ranks(df, ["by"], ["t"], "r", "o").collect()} == want_rank
    down = {r.t: r.o for r in scans.place_in(df, ["by"], [F.desc("t")], "o").collect()}
    assert down == {r[1]: k for own in by_list(rows).values() for k, r in enumerate(reversed(own), 1)}


def test_a_long_list_spans_blocks(spark, many_blocks):
    rows = scans.in_blocks(frame(spark, lists(2, 2000)), ["by"], ["t"])
    assert rows.where("by = 'hot'").select("_block").distinct().count() > 1


def test_rolling_sums_across_spans(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + timedelta(seconds=rng.randint(0, 400), microseconds=rng.choice([0, 1])), rng.randint(1, 5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at timestamp, v long, i long")
    got = {r.i: r.used for r in sampling.rolling_sum(df, "k", "at", "v").collect()}
    assert got == {i: sum(w for b, u, w, _ in rows if b == k and timedelta(0) <= t - u <= timedelta(seconds=60)) for k, t, _, i in rows}


def picked(motion, picks):
    if not motion or picks < 1:
        return []
    out, gap = [0], motion[-1] / picks
    want = gap
    for i, m in enumerate(motion):
        if motion[-1] > 1e-6 and i and m >= want and len(out) < picks:
            out.append(i)
            want = m + gap
    return out


@pytest.mark.parametrize("picks", [0, 1, 2, 5, 8, 33])
def test_motion_picks_are_those_of_the_loop(spark, picks):
    rng = random.Random(picks)
    rows, want = [], set()
    for g in range(12):
        motion, total = [], 0.0
        for _ in range(rng.choice([1, 2, 30, 90])):
            motion.append(total)
            total += rng.choice([0, 0, 0, 1, 2, 64]) if g % 4 else 0
        rows += [(g, float(t), m) for t, m in enumerate(motion)]
        want |= {(g, float(i)) for i in picked(motion, picks)}
    df = spark.createDataFrame(rows, "g long, t double, m double")
    found = [tuple(r) for r in sampling.equal_motion_picks(df, "g", "t", "m", picks).collect()]
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("few", [1, 3, 4096])
def test_upper_median_by_brackets(spark, few):
    rng = random.Random(few)
    groups = {
        "one": [5.0], "two": [1.0, 9.0], "same": [2.0] * 900, "none": [0.0, -1.0],
        "many": [rng.lognormvariate(0, 3) for _ in range(1500)], "ties": [float(rng.randint(1, 4)) for _ in range(1001)],
        "far": [1e-300, *([1.0] * 700), *([3.0] * 701), 1e300], "nulls": [None, 3.0, 1.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(None, 3.0)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, v double")
    want = {}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and v > 0)
        if vs:
            want[g] = (len(vs), vs[len(vs) // 2])
    assert {r.g: (r.n, r.median) for r in clean.upper_median(df, "g", "v", few).collect()} == want


def led(rows, least):
    heads, out = {}, {}
    for g, key, seq in sorted(rows, key=lambda r: r[2]):
        mine = heads.setdefault(g, [])
        lead = next((s for k, s in mine if key and likeness(key, k) >= least), None)
        out[g, seq] = seq if lead is None else lead
        if lead is None:
            mine.append((key, seq))
    return out


@pytest.mark.parametrize("first", [1, 5, 256])
def test_leaders_are_those_of_the_loop(spark, first):
    rng = random.Random(first)
    names = made(21, 250, "abcdef", 8)
    keys = [(g, x) for g in ("u", "v") for x in names if rng.random() < 0.7] + [("u", ""), ("w", ""), ("x", "abc")]
    rows = [(g, x, s) for s, (g, x) in enumerate(rng.sample(keys, len(keys)))]
    df = spark.createDataFrame(rows, "g string, key string, seq long")
    got = {(r.g, r.seq): r.leader for r in leaders.first_leaders(df, ["g"], "key", "seq", 0.6, first).collect()}
    assert got == led(rows, 0.6)
    assert leaders.first_leaders(df.limit(0), ["g"], "key", "seq", 0.6).collect() == []


def test_a_chain_of_leaders(spark):
    """Each name resembles only the ones beside it, so every other one leads."""
    rows = [("g", "".join(chr(97 + (i + j) % 26) for j in range(5)), i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, key string, seq long")
    got = {(r.g, r.seq): r.leader for r in leaders.first_leaders(df, ["g"], "key", "seq", 0.6).collect()}
    assert got == led(rows, 0.6) and len(set(got.values())) > 3
