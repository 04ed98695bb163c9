"""Destination sheets: headings to fields, rows to headings, repeats, insertion with undo."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardflow.functions.text import EXOTIC, exoticness, once, shown_key, usable_fold
from boardflow.operators.hold import hold, spread

# The fields and the heading patterns of each, in the order in which they claim headings.
FIELDS = {
    "place": [r"^#$", r"\brank\b", r"\bplace\b", r"\bpos(ition)?\b", r"^no\.?$"],
    "search": [r"search", r"roster name", r"^name$", r"player", r"member"],
    "ingame": [r"in ?game", r"game ?name", r"display", r"shown"],
    "alliance": [r"alliance", r"^team$", r"^clan$"],
    "points": [r"points?", r"score", r"\bcp\b", r"power", r"fame", r"total"],
    "date": [r"date", r"\bday\b(?!\s*\d)", r"when"],
    "label": [r"label", r"round", r"stage", r"snapshot", r"^day \d"],
}
OPTIONAL = ("date", "label")


def clean_heading(heading: str | None) -> str:
    return re.sub(r"\s+", " ", (heading or "").lower()).strip()


def guess_fields(headings: list[str] | None) -> list[tuple[str, str | None]]:
    """(heading, field) in the headings' order: each field takes the first unclaimed heading that fits. Blank ones get none."""
    cleaned = [clean_heading(h) for h in headings or []]
    got: dict[int, str] = {}
    for field, patterns in FIELDS.items():
        at = next((i for i, h in enumerate(cleaned) if h and i not in got and any(re.search(p, h) for p in patterns)), None)
        if at is not None:
            got[at] = field
    return [(h, got.get(i)) for i, h in enumerate(headings or [])]


def unmapped(mapping: list[tuple[str, str | None]]) -> list[str]:
    have = {field for _, field in mapping}
    return [f for f in FIELDS if f not in have and f not in OPTIONAL]


def guess_fields_of(sheets: DataFrame, headings: str = "headings") -> DataFrame:
    """``guess_fields`` and ``unmapped`` for a table of sheets: ``fields`` (a field or null for each of the ``headings``) and ``missing``.

    Which fields fit is worked out once for each heading. Then the fields claim
    headings one after the other, in SQL functions over a row's own array, each
    of a step's values named once. Null headings are blank ones, null arrays empty.
    """
    kept, bits = sheets.columns, {field: 1 << i for i, field in enumerate(FIELDS)}

    def fits(h: Column) -> Column:
        """A bit for each field that a clean heading fits."""
        of = [F.when(h.rlike("|".join(f"(?:{p})" for p in patterns)), bits[field]).otherwise(0) for field, patterns in FIELDS.items()]
        return F.when(h == "", 0).otherwise(sum(of[1:], of[0]))

    cleaned = F.transform(F.coalesce(headings, F.array().cast("array<string>")), lambda h: F.trim(F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"\s+", " ")))
    # All cores share the rows, however few files they come from; in a generator they are worked out once.
    rows = spread(sheets).select(*kept, F.explode(F.array(F.transform(cleaned, lambda h: once(h, fits)))).alias("_fits"))

    def claim(taken: Column, field: str) -> Column:
        """``taken``: for each field the place of its heading from 1, 0 without; a field more."""
        free = F.transform("_fits", lambda b, i: (b.bitwiseAND(F.lit(bits[field])) != 0) & ~F.array_contains(taken, (i + 1).cast("int")))
        return F.concat(taken, F.array(F.array_position(free, True).cast("int")))

    got = F.array().cast("array<int>")
    for field in FIELDS:
        got = once(got, lambda taken: claim(taken, field))  # noqa: B023
    rows = rows.withColumn("_got", F.explode(F.array(got)))
    names = F.array(*[F.lit(f) for f in FIELDS])
    found = F.transform("_fits", lambda b, i: once(F.array_position("_got", (i + 1).cast("int")).cast("int"), lambda at: F.when(at > 0, F.get(names, at - 1))))
    missing = F.array_compact(F.array(*[F.when(F.get("_got", F.lit(i)) == 0, F.lit(f)) for i, f in enumerate(FIELDS) if f not in OPTIONAL]))
    return rows.select(*kept, found.alias("fields"), missing.alias("missing"))


def sheet_columns(mapping: list[tuple[str, str | None]], extra: dict[str, str] | None = None) -> list[Column]:
    """A column for each heading: a field's value as text, run metadata for date and label, else ''. Zero is a value, null is ''."""
    extra = extra or {}
    out = []
    for i, (_, field) in enumerate(mapping):
        if field is None:
            value = F.lit("")
        elif field in OPTIONAL:
            value = F.lit(extra.get(field) or "")
        else:
            value = F.coalesce(F.col(field).cast("string"), F.lit(""))
        out.append(value.alias(f"c{i}"))
    return out


def to_sheet(rows: DataFrame, mapping: list[tuple[str, str | None]], extra: dict[str, str] | None = None) -> DataFrame:
    return rows.select(*sheet_columns(mapping, extra)).toDF(*[h for h, _ in mapping])


def keyed_row(mapping: list[tuple[str, str | None]], extra: dict[str, str] | None = None) -> Column:
    """A map from each mapped heading, trimmed and in lower case, to the cell: what a check for repeats compares."""
    cells = dict(zip([h for h, _ in mapping], sheet_columns(mapping, extra), strict=True))
    named = {h.strip().lower(): cells[h] for h, field in mapping if field and h}
    return F.create_map(*[x for h, c in named.items() for x in (F.lit(h), c)])


def key_headings(mapping: list[tuple[str, str | None]], extra: dict[str, str] | None = None) -> list[str]:
    """Headings that tell rows apart: the roster name, or else the game name; and the date, if one is set."""
    at = {field: heading for heading, field in mapping if field}
    key = [at[f] for f in ("search", "ingame") if f in at][:1]
    return key + [at["date"]] if "date" in at and (extra or {}).get("date") else key


def find_duplicates(rows: DataFrame, existing: DataFrame, keys: list[str], index: str = "index", row: str = "row") -> DataFrame:
    """Rows that a sheet has already, by what the key cells show: ``index`` and the first such ``row``.

    Case, spacing and style are ignored. A row whose keys are all empty is no
    repeat. The sheet is one row per distinct key before it is joined.
    """
    cells = F.array(*[shown_key(F.col(f"`{k}`").cast("string")) for k in keys]).cast("array<string>")
    # Keys are as long as cells are, so rows meet by a hash of them. In a generator they are folded once, whatever filters come later.
    hashed = once(cells, lambda k: F.when(F.array_max(k) != "", F.array(F.sha2(F.to_json(k), 256))))
    keyed = lambda df, own: df.select(own, F.explode(hashed).alias("k"))
    first = keyed(existing, row).groupBy("k").agg(F.min(row).alias(row))
    return keyed(rows, index).join(first, "k").select(index, row)


def keep_rows(rows: DataFrame, dropped: DataFrame, index: str = "index") -> DataFrame:
    return rows.join(dropped.select(index).distinct(), index, "left_anti").select(*rows.columns)


def insert_rows(existing: DataFrame, added: DataFrame, write_id: str, before: int | None = None, position: str = "row") -> DataFrame:
    """``added`` (in its ``position`` order, from 1) at the end or before row ``before``, marked with ``write_id``.

    Rows keep their order; none is cleared. Columns that ``added`` lacks are ''.
    """
    n = added.agg(F.count("*").alias("n"))
    end = existing.agg(F.coalesce(F.max(position), F.lit(0)).alias("end"))
    at = end.select(F.least(F.lit(before), F.col("end") + 1).alias("at") if before is not None else (F.col("end") + 1).alias("at"))
    both = at.join(F.broadcast(n))  # one row each
    names = [c for c in existing.columns if c not in (position, "write_id")]
    old = existing.join(F.broadcast(both)).withColumn(position, F.col(position) + F.when(F.col(position) >= F.col("at"), F.col("n")).otherwise(0))
    mark = F.col("write_id") if "write_id" in existing.columns else F.lit(None).cast("string").alias("write_id")
    new = added.join(F.broadcast(both)).withColumn(position, F.col("at") + F.col(position) - 1)
    values = [(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in added.columns else F.lit("")).alias(c) for c in names]
    old = old.select(F.col(position).cast("long").alias(position), *[F.col(f"`{c}`").cast("string").alias(c) for c in names], mark)
    return old.unionByName(new.select(F.col(position).cast("long").alias(position), *values, F.lit(write_id).alias("write_id")))


def undo(sheet: DataFrame, write_id: str, position: str = "row") -> DataFrame:
    """Without the rows of one write, by its id, whatever has moved since; the rows below close up."""
    gone = sheet.where(F.col("write_id") == write_id)
    span = gone.agg(F.min(position).alias("low"), F.count("*").alias("n"))
    kept = sheet.where(F.coalesce(F.col("write_id") != write_id, F.lit(True))).join(F.broadcast(span))  # one row
    return kept.withColumn(position, F.col(position) - F.when(F.col(position) > F.coalesce("low", F.lit(1 << 60)), F.col("n")).otherwise(0)).drop("low", "n")


def write_receipt(sheet: DataFrame, write_id: str, name: str, position: str = "row") -> DataFrame:
    mine = sheet.where(F.col("write_id") == write_id)
    return mine.agg(F.count("*").alias("written"), F.min(position).alias("from"), F.max(position).alias("to")).withColumn("sheet", F.lit(name))


def append_audit(line: str, spark, path: str) -> None:
    """One line more in an audit table."""
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(line).alias("line")).write.mode("append").parquet(path)


def output_rows(resolved: DataFrame, by: str = "board_id") -> DataFrame:
    """Resolved rows in the fields of a sheet: place, search, ingame, alliance, points; an unmatched row shows its reading as game name."""
    from boardflow.operators.consolidate import board_order
    from boardflow.operators.ranks import fill_ranks

    order = [F.desc("points"), F.coalesce("seenRank", F.lit(9999)), "group_pos"]
    placed = fill_ranks(resolved, [by], order, "seenRank", "place")
    index = F.row_number().over(board_order(by))
    game = F.coalesce(F.nullif(F.col("ingame"), F.lit("")), F.col("name"))
    return placed.select(by, index.alias("index"), "place", F.coalesce("search", F.lit("")).alias("search"), game.alias("ingame"), F.coalesce("alliance", F.lit("")).alias("alliance"), "points")


def layout(df: DataFrame, name: str, order: list[Column | str], across: int = 4) -> DataFrame:
    """The stylised names of a roster in order, ``across`` in a line: line and place from 0.

    Numbers come from counts of blocks of the order, so no task holds all names.
    """
    rows = df.where((F.trim(F.coalesce(name, F.lit(""))) != "") & (exoticness(F.coalesce(name, F.lit(""))) >= EXOTIC))
    return numbered(rows, order, "_at").withColumn("line", F.expr(f"_at div {across}")).withColumn("place", F.col("_at") % across).drop("_at")


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Rows numbered from 0 in an order: sorted by ranges, with one row for each range in the one window over all."""
    sorted_ = hold(df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_in": F.monotonically_increasing_id()}))
    sizes = sorted_.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before", "_first")
    return sorted_.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_in") - F.col("_first")).drop("_range", "_in", "_before", "_first")  # a row for each range


def prompt_names(roster: DataFrame) -> DataFrame:
    """roster_id, entry, and symbols: how a prompt names each entry, and an entry without letters by its code points.

    ``entry`` is ``search = ingame`` where both are there and differ, null without
    a ``search``. ``symbols`` is null for names with letters; joiners and selectors have no code point there.
    """
    search, ingame = F.trim("search"), F.trim("ingame")
    entry = F.when((ingame != "") & (search != ingame), F.concat(search, F.lit(" = "), ingame)).otherwise(search)
    points = F.filter(F.split(ingame, ""), lambda c: (c != "") & (c > "\u2000") & ~c.isin("\u200d", "\ufe0f", "\ufe0e"))
    # The four bytes of a code point in UTF-32 are its number.
    codes = F.array_join(F.transform(points, lambda c: F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+", ""))), " ")
    sign = F.concat(search, F.lit(" = "), ingame, F.when(codes != "", F.concat(F.lit(" ["), codes, F.lit("]"))).otherwise(""))
    return roster.select("roster_id", F.when(search != "", entry).alias("entry"), F.when((ingame != "") & (usable_fold(ingame) == ""), sign).alias("symbols"))
