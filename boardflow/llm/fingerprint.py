"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations.

A text is cut into paragraphs: its lines, and longer lines into runs of
``UNITS`` units, words or pieces of words. A short text is cut finer too, into
runs of a few code points and, if it is very short, into single ones. Such a cut
is a function of the text alone; two texts are compared by the finest one that
both have. The 64-bit digests of the distinct paragraphs of a cut fill a table of
cells. Each digest falls into one cell of each of three subtables; a cell holds a
count, the xor of its digests and the xor of their check hashes. A fingerprint is
the tables of all cuts. Two tables subtract cell by cell, what both texts share
cancels out, and peeling cells of one digest recovers the digests that differ.
Where peeling gets stuck, both tables are made anew, larger, and larger again:
digests are dealt into blocks, each with a table sized for all its digests, and a
block that gets stuck is tried at four times the size, and so on.

Likeness is the Jaccard similarity of the two paragraph sets, from their sizes
and the number of recovered digests; two texts without words are alike (1).

The next document is found from ids alone, in ranges of ids; a text is shuffled
once by its own key (both branches read the same columns, so that Spark reuses
the exchange), and its head once to the document that it edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardflow.llm.common import pick, table

UNITS = 16  # units in a paragraph
UNIT = 12  # code points in a unit, at most
FINER = ((512, 6), (32, 1))  # texts under so many code points are also cut into runs of so many
SUBTABLE = 8  # cells of each of the three subtables of a fingerprint's table
BLOCK = 8  # digests, of both texts, in a block of a larger sketch
LARGER = (1, 4, 16, 64)  # sizes that a block is tried with, one after the other
ROUNDS = 14  # of peeling; each takes all cells of one digest at once, so few are needed


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests_sql(text: str, run: int = 0) -> str:
    """SQL: distinct 64-bit digests of the paragraphs of a text, or of its runs of ``run`` code points."""
    pattern = rf"\S{{1,{run}}}" if run else rf"(?:\S{{1,{UNIT}}}[^\S\n]*){{1,{UNITS}}}"
    return f"array_distinct(transform(regexp_extract_all({text}, r'{pattern}', 0), p -> xxhash64(rtrim(p))))"


def common_cut_sql(cuts: dict[int, str], n: str, m: str) -> str:
    """SQL: of the cuts of a text (0: paragraphs; else by the length of runs) the finest that texts of ``n`` and ``m`` code points both have."""
    out = cuts[0]  # FINER goes from coarse to fine
    for most, run in FINER:
        out = f"if({n} < {most} and {m} < {most}, {cuts[run]}, {out})"
    return out


def _places(key: str, sub: str) -> str:
    """SQL: a digest's cell in each subtable; other sizes have other hashes, so that digests that share all cells part."""
    return ", ".join(f"cast({j} * {sub} + pmod(xxhash64({key}, {j}, {sub}), {sub}) as int) as p{j}" for j in range(3))


def cells_sql(keys: str, sub: str) -> str:
    """SQL: the cells array<struct<n, x, h>> of a sketch with three subtables of ``sub`` cells."""
    entries = f"transform({keys}, k -> struct(k as k, xxhash64(k, 'check') as h, {_places('k', sub)}))"
    empty = "struct(0 as n, 0L as x, 0L as h)"
    add = "(s, e) -> struct(s.n + 1 as n, s.x ^ e.k as x, s.h ^ e.h as h)"
    parts = ", ".join(f"transform(sequence({j} * {sub}, ({j} + 1) * {sub} - 1), c -> aggregate(filter(es, e -> e.p{j} = c), {empty}, {add}))" for j in range(3))
    return _let(entries, "es", f"concat({parts})")


def peel_sql(left: str, right: str, sub: str) -> str:
    """SQL: number of digests in one sketch only, or null where peeling gets stuck."""
    minus = f"zip_with({left}, {right}, (a, b) -> struct(a.n - b.n as n, a.x ^ b.x as x, a.h ^ b.h as h))"
    single = "filter(st.cells, c -> abs(c.n) = 1 and xxhash64(c.x, 'check') = c.h)"
    pure = f"array_distinct(transform({single}, c -> struct(c.x as x, c.n as n, c.h as h, {_places('c.x', sub)})))"
    take = "(q, p) -> struct(q.n - p.n as n, q.x ^ p.x as x, q.h ^ p.h as h)"
    rest = f"transform(st.cells, (c, i) -> aggregate(filter(pure, p -> p.p0 = i or p.p1 = i or p.p2 = i), c, {take}))"
    step = _let(pure, "pure", f"if(size(pure) = 0, struct(st.cells as cells, st.got as got, true as over), struct({rest} as cells, st.got + size(pure) as got, false as over))")
    end = "if(exists(st.cells, c -> c.n != 0 or c.x != 0 or c.h != 0), cast(null as int), st.got)"
    return f"aggregate(sequence(1, {ROUNDS}), struct({minus} as cells, 0 as got, false as over), (st, r) -> if(st.over, st, {step}), st -> {end})"


def likeness_sql(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: likeness of two paragraph sets (arrays of distinct digests) by their fingerprints' cells, and by larger sketches where those can't be peeled."""
    blocks = f"1 + (size({a}) + size({b})) div {BLOCK}"
    split = lambda keys: f"transform({keys}, k -> struct(k as k, pmod(xxhash64(k, 'outer'), no) as o, pmod(xxhash64(k, 'inner'), ni) as i))"
    outer = lambda keys: f"filter({keys}, e -> e.o = u)"
    inner = lambda keys: f"transform(filter({keys}, e -> e.i = v), e -> e.k)"

    def larger(times: int) -> str:
        return _let(f"{times} * (4 + (size(pa) + size(pb)) div 2)", "sub", peel_sql(cells_sql("pa", "sub"), cells_sql("pb", "sub"), "sub"))

    total = lambda each: f"aggregate({each}, 0, (t, d) -> t + d)"
    block = _let(inner("oa"), "pa", _let(inner("ob"), "pb", f"coalesce({', '.join(map(larger, LARGER))})"))
    some = _let(outer("ea"), "oa", _let(outer("eb"), "ob", total(f"transform(sequence(0, ni - 1), v -> {block})")))
    every = _let(split(a), "ea", _let(split(b), "eb", total(f"transform(sequence(0, no - 1), u -> {some})")))
    # Blocks in two steps, so that no digest is looked at once for each block.
    every = _let(f"cast(ceil(sqrt({blocks})) as int)", "no", _let(f"cast(ceil(({blocks}) / no) as int)", "ni", every))
    first = peel_sql(cells_a, cells_b, str(SUBTABLE))
    both = f"(size({a}) + size({b}))"
    return f"if({both} = 0, 1D, {_let(f'coalesce({first}, {every})', 'd', f'cast({both} - d as double) / ({both} + d)')})"


def fingerprint_sql(keys: str, cells: str) -> str:
    """SQL: a sketch as text: number of digests, then count.xor.check of every cell in hexadecimal."""
    return f"concat(size({keys}), ':', array_join(transform({cells}, c -> concat(c.n, '.', hex(c.x), '.', hex(c.h))), ','))"


def successors(keys: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """Add next_id0 and next_mark, the row after each one in descending doc_id (null last), then mark; after the last, the first.

    ``keys`` has distinct (doc_id, id0, mark). Ranges come from quantiles of
    the ids, 1024 at most, so no window holds all rows.
    """
    total = keys.count()
    parts = max(1, min(1024, total // range_rows))
    cuts = [(i + 1) / parts for i in range(parts - 1)]
    bounds = sorted(set(keys.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or [])) if cuts else []
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1)
    part = part.otherwise(F.expr(f"size(filter(array({', '.join(f'{b}L' for b in bounds)}), b -> b > doc_id))") if bounds else F.lit(0))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "mark")
    key = F.struct("id0", "mark")
    rows = keys.withColumn("part", part).withColumn("next", F.lead(key).over(order)).withColumn("nth", F.row_number().over(order))
    in_order = Window.orderBy("part")  # one row for each range
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = rows.where("nth = 1").select("part", F.struct("id0", "mark").alias("head"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(in_order), F.first("head").over(everything)).alias("head"))
    rows = rows.join(F.broadcast(heads), "part").withColumn("next", F.coalesce("next", "head"))  # 1026 rows at most
    return rows.select("id0", "mark", F.col("next.id0").alias("next_id0"), F.col("next.mark").alias("next_mark"), *[c for c in keys.columns if c not in ("doc_id", "id0", "mark")])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, id0, mark, text, n_chars, keys (paragraph digests) for every row; null text counts as empty."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64(F.col("doc_id").isNull(), "text")).withColumn("n_chars", F.char_length("text").cast("long"))
    return rows


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare.

    Edited: the last floor(n_chars / 3) characters give way to the first as
    many (or all) of the next document, in descending doc_id; after the last
    comes the first. Rows alike in doc_id and text are one document, and each is
    returned; rows with the same doc_id and other texts follow one another in
    the order of their texts' hashes; a null doc_id comes last. A lone document
    is its own next one. An empty table gives none.

    near_edited and near_next are by the finest cut that both texts have.
    """
    rows = fingerprints(docs, id_col, text_col)
    chain = successors(rows.select("doc_id", "id0", "mark", "n_chars").distinct())
    chain = chain.select(F.col("next_id0").alias("id0"), F.col("next_mark").alias("mark"), F.col("id0").alias("to_id0"), F.col("mark").alias("to_mark"), F.floor(F.col("n_chars") / 3).alias("take"))
    least = FINER[0][0]
    heads = rows.join(chain, ["id0", "mark"]).select(
        "to_id0",
        "to_mark",
        F.expr("left(text, cast(take as int))").alias("head"),
        F.expr(digests_sql("text")).alias("next_keys"),
        F.expr(f"if(n_chars < {least}, text, null)").alias("next_text"),
        F.col("doc_id").alias("next_doc_id"),
        F.col("n_chars").alias("next_n_chars"),
    )
    once = Window.partitionBy("to_id0", "to_mark").orderBy("to_mark")
    heads = heads.withColumn("nth", F.row_number().over(once)).where("nth = 1").withColumnsRenamed({"to_id0": "id0", "to_mark": "mark"}).drop("nth")
    both = rows.join(heads, ["id0", "mark"]).withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), head)"))
    both = both.withColumn("edited_n_chars", F.expr("cast(char_length(edited) as long)")).withColumn("edited_sha256", F.sha2("edited", 256))
    cuts: dict[str, dict[int, str]] = {"own": {0: "own_0"}, "edited": {0: "edited_0"}, "next": {0: "next_keys"}}
    both = both.withColumns({"own_0": F.expr(digests_sql("text")), "edited_0": F.expr(digests_sql("edited"))})
    for most, run in FINER:
        for side, text, n in (("own", "text", "n_chars"), ("edited", "edited", "edited_n_chars"), ("next", "next_text", "next_n_chars")):
            cuts[side][run] = f"{side}_{run}"
            both = both.withColumn(f"{side}_{run}", F.expr(f"if({n} < {most}, {digests_sql(text, run)}, null)"))
    both = both.drop("text", "edited", "head", "next_text")
    cells = {side: {run: f"{c}_cells" for run, c in of.items()} for side, of in cuts.items()}
    both = both.withColumns({cells[side][run]: F.expr(f"if({c} is null, null, {cells_sql(c, str(SUBTABLE))})") for side, of in cuts.items() for run, c in of.items()})
    pairs = {}
    for side in ("edited", "next"):
        for what, columns in (("", cuts), ("_cells", cells)):
            pairs |= {f"{x}_{side}{what}": F.expr(common_cut_sql(columns[own], "n_chars", f"{side}_n_chars")) for x, own in (("a", "own"), ("b", side))}
    both = both.withColumns(pairs)
    of = lambda side: F.concat_ws("/", *[F.expr(f"if({c} is null, null, {fingerprint_sql(c, cells[side][run])})") for run, c in cuts[side].items()])
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        of("own").alias("fingerprint"),
        of("edited").alias("edited_fingerprint"),
        *[F.expr(likeness_sql(f"a_{side}", f"b_{side}", f"a_{side}_cells", f"b_{side}_cells")).alias(f"near_{side}") for side in ("edited", "next")],
        "next_doc_id",
        "next_n_chars",
    )


def op6_lookup_sketches(spark, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
