"""Joins of similar names against all pairs by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from boardflow.operators import alike, hold, leaders
from boardflow.operators.alike import alike_pairs, loose_pairs, near_symbol_pairs, probe_keys, segment_keys
from boardflow.operators import resolve as resolving
from boardflow.operators.resolve import most_similar, near_symbols


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else 1 - edits(a, b) / max(len(a), len(b))


def made(seed, n, letters="abcd", longest=12):
    """Random names, half of them small changes of others, and some that repeat a letter."""
    rng = random.Random(seed)
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]
    for k in range(0, n, 2):
        name = list(rng.choice(names))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(name) + 1)
            name[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        names[k] = "".join(name) or "a"
    return sorted({*names, "aaaaaaaa", "aaaaaaa", "aaaabaaaa", "a", "b", "ab"})


@pytest.mark.parametrize(("least", "letters"), [(0.5, "abc"), (0.6, "abcdefghij"), (0.65, "ab"), (0.8, "abcdef0"), (1.0, "ab")])
def test_alike_pairs_loses_none(spark, least, letters):
    a, b = made(1, 150, letters), made(2, 150, letters)
    left = spark.createDataFrame([(x,) for x in a], "key string")
    right = spark.createDataFrame([(y,) for y in b], "form_key string")
    got = [(r.key, r.form_key, round(r.s, 9)) for r in alike_pairs(left, right, least).collect()]
    want = [(x, y, round(s, 9)) for x in a for y in b if (s := likeness(x, y)) >= least]
    assert sorted(got) == sorted(want)


def test_alike_pairs_within_groups(spark):
    names = made(3, 60)
    rows = [(g, float(p), x) for g in ("u", "v") for p in (1, 2) for x in names if random.Random(x + g).random() < 0.6]
    df = spark.createDataFrame(rows, "board string, points double, key string")
    got = alike_pairs(df, df.withColumnRenamed("key", "form_key"), 0.6, ("board", "points")).select("board", "points", "key", "form_key").collect()
    want = [(*a, b[2]) for a in rows for b in rows if a[:2] == b[:2] and likeness(a[2], b[2]) >= 0.6]
    assert sorted(map(tuple, got)) == sorted(want)


def test_alike_pairs_needs_half(spark):
    with pytest.raises(ValueError, match="half"):
        alike_pairs(spark.range(0), spark.range(0), 0.4)


@pytest.mark.parametrize(("least", "letters"), [(0.35, "abcdefghijkl"), (0.0, "abcdef"), (0.35, "ab")])
def test_loose_pairs_loses_none_that_shares_two_letters(spark, least, letters):
    a, b = made(4, 100, letters, 9), made(5, 100, letters, 9)
    left = spark.createDataFrame([(x,) for x in a], "key string")
    right = spark.createDataFrame([(y,) for y in b], "form_key string")
    got = {(r.key, r.form_key) for r in loose_pairs(left, right, least).collect()}

    def two_in_order(x, y):
        return any(y.find(x[j], y.find(x[i]) + 1) >= 0 for i in range(len(x)) if x[i] in y for j in range(i + 1, len(x)))

    want = {(x, y) for x in a for y in b if (s := likeness(x, y)) > 0 and s >= least and len(x) > 1 and len(y) > 1 and two_in_order(x, y)}
    assert got == want


@pytest.mark.parametrize(("n", "letters", "longest"), [(300, "abcdefghijklmnopqrstuvwxyz0123456789", 12), (200, "abcde", 5), (150, "ab", 20)])
def test_most_similar_is_the_best_of_all(spark, n, letters, longest):
    names, forms = made(6, n, letters, longest), made(7, n, letters, longest)
    rng = random.Random(8)
    readings = [(g, p, rng.choice(names)) for g in range(n) for p in range(2)]
    df = spark.createDataFrame(readings, "g long, pos int, key string")
    roster = [(i // 2, i, y) for i, y in enumerate(rng.sample(forms, len(forms)))] + [(900, 900, forms[0])]
    got = {r.g: (r.roster_id, round(r.near_score, 9)) for r in most_similar(df, spark.createDataFrame(roster, "roster_id long, ix_pos long, key string"), ["g"]).collect()}
    want = {}
    for g, p, x in readings:
        s, back, i = max((likeness(x, y), -ix, r) for r, ix, y in roster)
        if s > 0:
            want[g] = max(want.get(g, ((0.0, 0, 0), 0)), ((s, -p, back), i))
    assert got == {g: (i, round(s, 9)) for g, ((s, _, _), i) in want.items()}


def test_names_that_share_nothing_have_no_suggestion(spark):
    df = spark.createDataFrame([(1, 0, "xyz"), (2, 0, "ab")], "g long, pos int, key string")
    forms = spark.createDataFrame([(7, 0, "cba"), (8, 1, "qqqq")], "roster_id long, ix_pos long, key string")
    assert [tuple(r) for r in most_similar(df, forms, ["g"]).collect()] == [(2, 7, pytest.approx(1 / 3))]
    assert most_similar(df.limit(0), forms, ["g"]).collect() == []
    assert most_similar(df, forms.limit(0), ["g"]).collect() == []


def cap(a, b):
    return max(1, max(len(a), len(b)) // 3) if min(len(a), len(b)) >= 4 else 1


def test_segments_meet_all_near_symbols(spark):
    for letters, longest in (("★☆", 9), ("★☆☀☁☂", 14)):
        a, b = ([x for x in made(s, 150, letters, longest) if len(x) > 1] for s in (9, 10))
        left = spark.createDataFrame([(x,) for x in a], "x string").withColumn("part", F.explode(F.expr(probe_keys("x"))))
        right = spark.createDataFrame([(y,) for y in b], "y string").withColumn("part", F.explode(F.expr(segment_keys("y"))))
        got = {(r.x, r.y) for r in left.join(right, "part").select("x", "y").distinct().collect()}
        assert got >= {(x, y) for x in a for y in b if edits(x, y) <= cap(x, y)}


def test_near_symbols_are_of_one_entry(spark):
    names = [x for x in made(11, 120, "★☆☀☁☂☃", 8) if len(x) > 1 and not set(x) & set("ab")]
    rng = random.Random(12)
    forms = [(i, x) for i, x in enumerate(rng.sample(names, 60))] + [(0, names[0]), (1, "★")]
    left = spark.createDataFrame([(g, "", x) for g, x in enumerate(names)], "g long, key string, shown string")
    right = spark.createDataFrame([(i, "", x) for i, x in forms], "roster_id long, key string, shown string")
    want = {}
    for g, x in enumerate(names):
        hits = {i for i, y in forms if len(y) > 1 and edits(x, y) <= cap(x, y)}
        if len(hits) == 1:
            want[g] = hits.pop()
    assert {r.g: r.roster_id for r in near_symbols(left, right, ["g"]).collect()} == want


def test_near_symbols_by_kept_letters_equal_all_pairs(spark):
    a, b = ([x for x in made(s, 150, "★☆☀☁", 13) if len(x) > 1] for s in (13, 14))
    left = spark.createDataFrame([(x,) for x in a], "shown string")
    right = spark.createDataFrame(list(enumerate(b)), "roster_id long, form_shown string")
    got = {(r.shown, r.form_shown) for r in near_symbol_pairs(left, right).collect()}
    assert got == {(x, y) for x in a for y in b if edits(x, y) <= cap(x, y)}


def test_no_exploded_side_is_broadcast(spark):
    left = spark.createDataFrame([(1, "", "★☆☀☁☂☃")], "g long, key string, shown string")
    right = spark.createDataFrame([(1, "", "★☆☀☁☂♣")], "roster_id long, key string, shown string")
    out = near_symbols(left, right, ["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.roster_id for r in out.collect()] == [1]
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_part" in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_names_alike_follow_the_first_one_at_once(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("pairs of followers were looked for")

    monkeypatch.setattr(leaders, "alike_pairs", none)
    rows = [(b, 1.0, f"player{i}", 100 * b + i) for b in (1, 2) for i in range(10, 99)]
    items = spark.createDataFrame(rows, "board long, points double, key string, seq long")
    got = leaders.first_leaders(items, ["board", "points"], "key", "seq", 0.6)
    assert {(r.board, r.leader) for r in got.collect()} == {(1, 110), (2, 210)}
    assert got.count() == len(rows)


def test_leaders_meet_only_on_lengths_that_occur(spark, monkeypatch):
    """Six letters, two of which may be edited, have 15 choices of four; lengths that no name has bring none."""
    met = []

    def counted(left, right, *more):
        met.append((left.count(), right.count()))
        return hold.meet(left, right, *more)

    monkeypatch.setattr(alike, "meet", counted)
    names = sorted({"".join(random.Random(i).choices("0123456789abcdef", k=6)) for i in range(200)})
    items = spark.createDataFrame([(1, x, i) for i, x in enumerate(names)], "g long, key string, seq long")
    got = leaders.first_leaders(items, ["g"], "key", "seq", 0.6)
    want = []
    for i, x in enumerate(names):
        want.append(next((j for j in range(i) if want[j] == j and likeness(x, names[j]) >= 0.6), i))
    assert [r.leader for r in got.orderBy("seq").collect()] == want
    assert met and max(max(m) for m in met) <= 15 * len(names)


@pytest.mark.parametrize(("n", "m"), [(40, 90), (90, 40)])
def test_few_pairs_are_compared_outright(spark, monkeypatch, n, m):
    def none(*_, **__):
        raise AssertionError("few pairs need no rounds")

    monkeypatch.setattr(resolving, "alike_pairs", none)
    names, forms = made(15, n, "abcdefgh"), made(16, m, "abcdefgh")
    left = spark.createDataFrame([(g, 0, x) for g, x in enumerate(names)], "g long, pos int, key string")
    right = spark.createDataFrame([(i, i, y) for i, y in enumerate(forms)], "roster_id long, ix_pos long, key string")
    want = {g: max((likeness(x, y), -i) for i, y in enumerate(forms)) for g, x in enumerate(names)}
    got = {r.g: (r.roster_id, round(r.near_score, 9)) for r in most_similar(left, right, ["g"]).collect()}
    assert got == {g: (-back, round(s, 9)) for g, (s, back) in want.items() if s > 0}


def test_rounds_find_what_outright_comparison_finds(spark, monkeypatch):
    names, forms = made(17, 150, "abcdefghijkl0123"), made(18, 150, "abcdefghijkl0123")
    left = spark.createDataFrame([(g, 0, x) for g, x in enumerate(names)], "g long, pos int, key string")
    right = spark.createDataFrame([(i, i, y) for i, y in enumerate(forms)], "roster_id long, ix_pos long, key string")
    outright = sorted(map(tuple, most_similar(left, right, ["g"]).collect()))
    monkeypatch.setattr(resolving, "OUTRIGHT", 0)
    assert sorted(map(tuple, most_similar(left, right, ["g"]).collect())) == outright


def test_near_names_never_gather_their_cuts(spark):
    left = spark.createDataFrame([(1, "abcde", 1.0)], "g long, key string, exotic double")
    right = spark.createDataFrame([(7, "abcdf")], "roster_id long, key string")
    out = resolving.near_names(left, right, ["g"])
    assert [r.roster_id for r in out.collect()] == [7]
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and all("strategy=merge" in line for line in joins)
