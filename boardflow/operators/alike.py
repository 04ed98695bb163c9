"""Joins of similar names, as equi-joins on keys that lose no pair.

Four kinds of keys, by how alike names have to be:

* at least half alike and not short: pairs of neighbouring letters, numbered where they repeat.
  Every edit changes two of them at most, so of the rarest ``2 k + 1`` of each
  name one is shared (a prefix filter); the other name's length is in the key.
* less than that: two or three letters in order. Names that are ``least`` alike
  share that part of the longer one's letters in order, so the rarest of these
  are among a name's rarest letters.
* short names that few edits may be apart: all but ``k`` letters of the longer one,
  in order. Of names within ``k`` edits both have these.
* near symbols that are longer: ``k + 1`` segments of one name, of which the other
  has one whole, shifted no further than edits before and after it allow.

Letters count as rare by a fixed order; any order gives the same pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.functions.similarity import similarity, symbol_cap, symbols_near
from boardflow.operators.hold import meet, spread

RARE_FIRST, IN_ORDER = "987654321qxzjvkwyfbghpmucdltrnsioea0", "0123456789abcdefghijklmnopqrstuvwxyz"  # numbers tell names apart, zeros don't
KEPT_KEYS = 150  # names meet on kept letters where there are at most so many choices of them
BLOCK = 1024  # forms that a name is compared with at once
SHORT_SIGNS = 8  # names in symbols up to here may be two edits apart and have few keys of all letters but two
SLACK = 1e-9  # products of a share and a length are whole numbers at times


def ranked(key: Column) -> Column:
    """The name with its letters exchanged so that rare ones sort first; edits between names stay the same."""
    return F.translate(key, RARE_FIRST, IN_ORDER)


def _pairs(c: str) -> str:
    """SQL: the numbered letter pairs of a ranked name, rarest first. A pair's number tells its repeats apart."""
    grams = f"sort_array(transform(sequence(1, char_length({c}) + 1), i -> substring(concat('\\u0001', {c}, '\\u0001'), i, 2)))"
    return f"element_at(transform(array({grams}), gs -> transform(gs, (g, i) -> concat(g, i + 1 - array_position(gs, g)))), 1)"


def _kept_letters(c: str, n: str) -> str:
    """SQL: all distinct choices of ``n`` letters of a name, in their order."""
    size = f"char_length({c})"
    more = f"concat(transform(acc, a -> concat(a, substring({c}, i, 1))), acc)"
    return f"if({size} < {n}, array(), aggregate(sequence(1, {size}), array(''), (acc, i) -> array_distinct(filter({more}, a -> char_length(a) <= {n} and char_length(a) >= i - {size} + {n}))))"


def _cuts(spark: SparkSession, rows: list[tuple[int, int, int, int]], own: str, most_gone: int) -> DataFrame:
    """``own``, the other columns of ``rows`` (own length, _m, _most, letters to leave out) and all choices of places to leave out, one each row."""
    places = "".join(f", _d{i} int" for i in range(most_gone))
    found = [(n, m, most, *cut, *([n + 1] * (most_gone - gone))) for n, m, most, gone in rows for cut in combinations(range(1, n + 1), gone)]
    return spark.createDataFrame(found, f"{own} int, _m int, _most int{places}")


def _without(c: str, n: int) -> Column:
    """A name without the letters at the places ``_d0`` to ``_d{n - 1}``, which rise and may lie past its end."""
    starts = [F.lit(1), *[F.col(f"_d{i}") + 1 for i in range(n)]]
    ends = [*[F.col(f"_d{i}") for i in range(n)], F.char_length(c) + 1]
    return F.concat(*[F.substring(F.col(c), start, end - start) for start, end in zip(starts, ends)])


def alike_pairs(left: DataFrame, right: DataFrame, least: float, on: tuple[str, ...] = (), sizes: set[int] | None = None) -> DataFrame:
    """All pairs of distinct rows of ``left`` (``on``, key, others) and ``right`` (``on``, form_key, others) with equal ``on`` and similarity ``least`` (0.5 or more): both's columns and ``s``.

    Keys are not empty. A pair comes once. ``sizes``: all lengths that keys have, if they are known.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("letter pairs are sure to be shared only by names that are at least half alike")
    edits = lambda n: f"cast(floor((1 - {least}) * ({n}) + {SLACK}) as int)"
    k = lambda n: floor((1 - least) * n + SLACK)
    # By the longer length of a pair: names of few choices of kept letters meet on those, the others on letter pairs.
    short = [n for n in range(1, 65) if comb(n, k(n)) <= KEPT_KEYS]
    is_short = F.greatest("_n", "_m").isin(short)
    low, high = (lambda n: ceil(least * n - SLACK)), (lambda n: floor(n / least + SLACK))
    lengths = lambda n: f"sequence(cast(ceil({least} * {n} - {SLACK}) as int), cast(floor({n} / {least} + {SLACK}) as int))"
    a, b = spread(left, *on, "key").withColumn("_n", F.char_length("key")), spread(right, *on, "form_key").withColumn("_m", F.char_length("form_key"))
    met = [(n, m, max(n, m)) for n in short for m in range(max(1, low(n)), high(n) + 1) if max(n, m) in short and (sizes is None or {n, m} <= sizes)]
    ours = [(n, m, most, n - most + k(most)) for n, m, most in met]
    theirs = sorted({(m, m, most, m - most + k(most)) for _, m, most in met})
    gone = max((g for *_, g in ours + theirs), default=0)
    likeness = similarity(F.col("key"), F.col("form_key"))
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    # Sides meet on one number, which sorts fast; what it stands for is the same in both if they are alike.
    met_on = lambda c: F.xxhash64(*on, "_m", "_most", _without(c, gone)).alias("_part")
    a_short = a.join(F.broadcast(_cuts(left.sparkSession, ours, "_n", gone)), "_n").select(*left.columns, met_on("key"))
    b_short = b.join(F.broadcast(_cuts(left.sparkSession, theirs, "_of", gone).drop("_of")), "_m").select(*[F.col(c).alias(f"_on_{c}") if c in on else c for c in right.columns], met_on("form_key"))
    near = meet(a_short, b_short, "_part")
    for c in on:
        near = near.where(F.col(c) == F.col(f"_on_{c}"))
    near = near.select(*columns).withColumn("s", likeness).where(F.col("s") >= least).distinct()
    if sizes is not None and all(max(n, m) in short for n in sizes for m in sizes if low(n) <= m <= high(n)):
        return near
    a = a.withColumn("_m", F.explode(F.expr(lengths("_n")))).where(~is_short).withColumn("_y", ranked(F.col("key"))).withColumn("_px", F.expr(f"slice({_pairs('_y')}, 1, 2 * {edits('greatest(_n, _m)')} + 1)"))
    a = a.select(*left.columns, "_m", "_px")
    b = b.where(F.floor(F.col("_m") / least + SLACK) >= next(n for n in range(1, 66) if n not in short)).withColumn("_y", ranked(F.col("form_key")))
    b = b.withColumn("_py", F.expr(f"slice({_pairs('_y')}, 1, 2 * {edits(f'_m / {least}')} + 1)")).drop("_y")
    met = meet(a.withColumn("_part", F.explode("_px")), b.withColumn("_part", F.explode("_py")), [*on, "_m", "_part"])
    # A pair that shares several parts counts where it shares the rarest.
    met = met.where(F.col("_part") == F.array_min(F.array_intersect("_px", "_py"))).select(*columns)
    return near.unionByName(met.withColumn("s", likeness).where(F.col("s") >= least))


def best_of_all(names: DataFrame, n: int, forms: DataFrame, n_forms: int) -> DataFrame:
    """``key``, s, back, roster_id: of each of ``n`` names (key) the best of ``n_forms`` forms, compared outright, a block of forms at a time.

    The side with fewer rows goes to all tasks, so the product of both has to be bounded.
    """
    blocks = forms.groupBy(F.pmod(F.xxhash64("form_key"), F.lit(-(-n_forms // BLOCK))).alias("_b")).agg(F.collect_list(F.struct("form_key", "ix_pos", "roster_id")).alias("_forms"))
    both = spread(names.select("key"), "key").crossJoin(F.broadcast(blocks)) if n_forms < n else spread(blocks, "_b").crossJoin(F.broadcast(names.select("key")))
    of = lambda f: F.struct(similarity(F.col("key"), f["form_key"]).alias("s"), (-f["ix_pos"]).alias("back"), f["roster_id"].alias("roster_id"))
    best = both.select("key", F.array_max(F.transform("_forms", of)).alias("b"))
    return best.groupBy("key").agg(F.max("b").alias("b")).select("key", "b.*").where("s > 0")


def _combinations(c: str, need: str) -> str:
    """SQL: keys of the letters of a ranked name of which ``need`` (2 or more) are shared in order.

    A key says whether each side needs three or more: two that do meet by three
    letters, others by two. The name's own side comes first (see ``flip``).
    """
    n = f"char_length({c})"
    rare = lambda size: f"transform(array_sort(transform(slice(array_sort(transform(sequence(1, {n}), i -> struct(substring({c}, i, 1) as l, i as i))), 1, {n} - {need} + {size}), x -> struct(x.i as i, x.l as l))), x -> x.l)"
    two = lambda arr: f"flatten(transform({arr}, (p, i) -> transform(slice({arr}, i + 2, {n}), q -> concat(p, q))))"
    three = f"flatten(transform({rare(3)}, (o, k) -> flatten(transform(slice({rare(3)}, k + 2, {n}), (p, i) -> transform(slice({rare(3)}, k + i + 3, {n}), q -> concat(o, p, q))))))"
    tagged = lambda tag, keys: f"transform({keys}, k -> concat('{tag}', k))"
    short = f"concat({tagged('ss', two(rare(2)))}, {tagged('sl', two(rare(2)))})"
    long = f"concat({tagged('ls', two(rare(2)))}, {tagged('ll', three)})"
    return f"array_distinct(if({need} < 3, {short}, {long}))"


def loose_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of ``left`` (key) and ``right`` (form_key, others) that share two letters or more in order and are at least ``least`` alike: all columns and ``s``. A pair comes once."""
    need = lambda c: f"greatest(2, cast(ceil({least} * char_length({c}) - {SLACK}) as int))"
    a = left.where(F.char_length("key") > 1).withColumn("_x", ranked(F.col("key"))).withColumn("_part", F.explode(F.expr(_combinations("_x", need("_x"))))).drop("_x")
    b = right.where(F.char_length("form_key") > 1).withColumn("_y", ranked(F.col("form_key"))).withColumn("_part", F.explode(F.expr(_combinations("_y", need("_y"))))).drop("_y")
    flip = F.concat(F.substring("_part", 2, 1), F.substring("_part", 1, 1), F.expr("substring(_part, 3)"))
    met = meet(a, b.withColumn("_part", flip), "_part").drop("_part").distinct()
    return met.withColumn("s", similarity(F.col("key"), F.col("form_key"))).where((F.col("s") > 0) & (F.col("s") >= least))


def one_letter_best(names: DataFrame, forms: DataFrame) -> DataFrame:
    """``key``, s, back, roster_id: the best form by one letter in common alone, as far as places allow.

    Names and forms are reduced to (letter, place, length) before they meet: no
    more rows than letters times lengths squared, however many names there are.
    The score is what such an alignment gives; a form with more in common has a
    higher one, which ``loose_pairs`` finds.
    """
    spread = lambda df, c: df.select("*", F.char_length(c).alias("n"), F.posexplode(F.filter(F.split(c, ""), lambda x: x != "")).alias("i", "letter"))
    ours = spread(names.select("key"), "key")
    theirs = spread(forms, "form_key").groupBy("letter", F.col("i").alias("j"), F.col("n").alias("m")).agg(F.max(F.struct((-F.col("ix_pos")).alias("back"), "roster_id")).alias("f"))
    met = ours.select("letter", "i", "n").distinct().join(theirs, "letter")
    cost = F.greatest("i", "j") + F.greatest(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    met = met.withColumn("s", 1 - cost / F.greatest("n", "m")).where("s > 0")
    best = met.groupBy("letter", "i", "n").agg(F.max(F.struct("s", "f.back", "f.roster_id")).alias("b"))
    return ours.join(best, ["letter", "i", "n"]).groupBy("key").agg(F.max("b").alias("b")).select("key", "b.*")


def segment_keys(c: str) -> str:
    """SQL: every segment of a symbol name, for each number of edits that another name may bring: 'length|edits|number|segment'."""
    n = f"char_length({c})"
    cut = lambda i: f"cast(floor(({i}) * {n} / (k + 1)) as int)"
    one = f"concat_ws('|', {n}, k, i, substring({c}, {cut('i')} + 1, {cut('i + 1')} - {cut('i')}))"
    return f"flatten(transform(sequence(1, greatest(1, cast(floor({n} / 2) as int))), k -> transform(sequence(0, k), i -> {one})))"


def probe_keys(c: str) -> str:
    """SQL: what a symbol name has to look up to meet all names near it.

    Of the segments of a near name take the first one that is whole and whose
    edits before it are no more than segments before it: so it is shifted by no
    more than its number, and by no more than the edits left after it.
    """
    n = f"char_length({c})"
    cap = f"if(least({n}, m) >= 4, greatest(1, cast(floor(greatest({n}, m) / 3) as int)), 1)"
    cut = lambda i: f"cast(floor(({i}) * p.m / (p.k + 1)) as int)"
    low = f"greatest(0, {cut('i')} - i, {cut('i')} + {n} - p.m - (p.k - i))"
    high = f"least({n} - ({cut('i + 1')} - {cut('i')}), {cut('i')} + i, {cut('i')} + {n} - p.m + (p.k - i))"
    probes = f"transform(if({low} <= {high}, sequence({low}, {high}), array()), s -> concat_ws('|', p.m, p.k, i, substring({c}, s + 1, {cut('i + 1')} - {cut('i')})))"
    lengths = f"filter(transform(sequence(greatest(2, cast(ceil({n} / 2) as int)), {n} + cast(ceil({n} / 2) as int) + 1), m -> struct(m as m, {cap} as k)), p -> abs(p.m - {n}) <= p.k)"
    return f"array_distinct(flatten(transform({lengths}, p -> flatten(transform(sequence(0, p.k), i -> {probes})))))"


def near_symbol_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``left`` (shown) and ``right`` (roster_id, form_shown) that are near by edits, some more than once.

    Short ones meet on all letters but as many as may be edited, so that those
    which meet are nearly those which are near; longer ones on segments.
    """
    sizes = lambda df, c, n: df.select(F.char_length(c).alias(n)).distinct()
    lengths = sizes(left, "shown", "_n").crossJoin(sizes(right, "form_shown", "_m"))
    lengths = lengths.withColumn("_most", F.greatest("_n", "_m")).withColumn("_k", symbol_cap(F.expr("repeat('x', _n)"), F.expr("repeat('x', _m)")).cast("int")).where("_most - least(_n, _m) <= _k")
    a, b = left.withColumn("_n", F.char_length("shown")), right.withColumn("_m", F.char_length("form_shown"))
    few, many = lengths.where(F.col("_most") <= SHORT_SIGNS), lengths.where(F.col("_most") > SHORT_SIGNS)
    kept = lambda df, c: df.withColumn("_part", F.explode(F.expr(_kept_letters(c, "(_most - _k)")))).drop("_k")
    # A row for each pair of lengths that occurs.
    ours = kept(spread(a, "shown").join(F.broadcast(few), "_n"), "shown").drop("_n")
    theirs = kept(spread(b, "form_shown").join(F.broadcast(few.select("_m", "_most", "_k").distinct()), "_m"), "form_shown")
    short = meet(ours, theirs, ["_m", "_most", "_part"]).select(*left.columns, *right.columns)
    asked = a.withColumn("_part", F.explode(F.expr(probe_keys("shown")))).withColumn("_m", F.split_part("_part", F.lit("|"), F.lit(1)).cast("int"))
    asked = asked.join(F.broadcast(many.select("_n", "_m")), ["_n", "_m"])
    cut = b.withColumn("_part", F.explode(F.expr(segment_keys("form_shown")))).withColumn("_k", F.split_part("_part", F.lit("|"), F.lit(2)).cast("int"))
    cut = cut.join(F.broadcast(many.select("_m", "_k").distinct()), ["_m", "_k"])
    long = meet(asked, cut.drop("_m"), "_part").select(*left.columns, *right.columns).distinct()
    return short.unionByName(long).where(symbols_near(F.col("shown"), F.col("form_shown")))
