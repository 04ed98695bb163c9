"""Record linkage of consolidated rows to a roster, in tiers, as equi-joins.

A row has several readings of one name and, at times, a claim of who it is.
All candidates of all tiers are found by joins on keys, and one aggregate picks
the first one by tier and reading. No tier compares every row with every roster
entry: near names meet on deletion keys, near symbols on kept letters or segments, suggestions
on rare pairs of letters and, below half alike, on letters in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.functions.similarity import NEAR_LETTERS, claim_plausible, deletion_keys, within_one_edit
from boardflow.functions.text import EXOTIC, alias_key, exoticness, fold, symbols, usable
from boardflow.operators.alike import alike_pairs, best_of_all, loose_pairs, near_symbol_pairs, one_letter_best
from boardflow.operators.hold import hold, meet

# Tiers; within the ladder of one reading, rungs.
ALIAS, FOLD, CLAIM, LADDER = range(1, 5)
FREE, FIRST, SYMBOL, NEAR, NEAR_SYMBOL = range(5)
VIA = {ALIAS: "alias", FOLD: "name", CLAIM: "claim"}
RUNG_VIA = {FREE: "alias", FIRST: "first name", SYMBOL: "symbol", NEAR: "near", NEAR_SYMBOL: "near symbol"}


def name_keys(df: DataFrame, name: str) -> DataFrame:
    """``df`` with what matching needs of a name: fold, key (usable fold), shown (symbols), exotic, any (fold or symbols)."""
    out = df.withColumn("fold", fold(F.col(name))).withColumn("shown", symbols(F.col(name)))
    return (
        out.withColumn("key", usable(F.col("fold"), F.col(name)))
        .withColumn("exotic", exoticness(F.coalesce(F.col(name), F.lit(""))))
        .withColumn("any", F.when(F.col("fold") != "", F.col("fold")).when(F.col("shown") != "", F.concat(F.lit("\u0002"), "shown")).otherwise(""))
    )


def roster_forms(roster: DataFrame) -> DataFrame:
    """One row for each name of an entry: roster_id, ix_pos (order of search), form, and its keys."""
    forms = roster.select("roster_id", F.posexplode(F.array("search", "ingame")).alias("i", "form")).where("form != ''")
    forms = forms.select("roster_id", (F.col("roster_id") * 2 + F.col("i")).alias("ix_pos"), "form")
    return name_keys(forms, "form")


def first_hit(left: DataFrame, forms: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` with the first roster entry whose key is equal (hash lookup)."""
    first = forms.where(F.col(on) != "").groupBy(on).agg(F.min_by("roster_id", "ix_pos").alias("roster_id"))
    return meet(left, first, on)


def sole_owner(forms: DataFrame, on: str) -> DataFrame:
    """Keys that exactly one roster entry has: ``on``, roster_id."""
    owners = forms.where(F.col(on) != "").groupBy(on).agg(F.min("roster_id").alias("roster_id"), F.max("roster_id").alias("other"))
    return owners.where("roster_id = other").drop("other")


def _sole(pairs: DataFrame, keys: list[str]) -> DataFrame:
    found = pairs.groupBy(*keys).agg(F.min("roster_id").alias("roster_id"), F.max("roster_id").alias("other"))
    return found.where("roster_id = other").drop("other")


def near_names(readings: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """Stylised readings within one edit of the key of exactly one entry: ``keys``, roster_id."""
    left = readings.where((F.char_length("key") >= NEAR_LETTERS) & (F.col("exotic") >= EXOTIC)).select(*keys, "key", F.explode(deletion_keys(F.col("key"))).alias("cut"))
    right = forms.where(F.char_length("key") >= NEAR_LETTERS).select("roster_id", F.col("key").alias("form_key")).distinct()
    right = right.withColumn("cut", F.explode(deletion_keys(F.col("form_key"))))
    return _sole(meet(left, right, "cut").where(within_one_edit(F.col("key"), F.col("form_key"))), keys)


def near_symbols(readings: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """Readings in symbols near those of exactly one entry in symbols: ``keys``, roster_id."""
    left = readings.where((F.col("key") == "") & (F.char_length("shown") >= 2)).select(*keys, "shown")
    right = forms.where((F.col("key") == "") & (F.char_length("shown") >= 2)).select("roster_id", F.col("shown").alias("form_shown")).distinct()
    near = _sole(near_symbol_pairs(left.select("shown").distinct(), right), ["shown"])
    return _sole(meet(left, near, "shown"), keys)


#: Names leave as soon as the best of what is this much alike is known; so few are left for the weaker filters.
ROUNDS, LOOSE_ROUNDS = (0.9, 0.85, 0.75, 0.5), (0.35, 0.0)
#: Names and forms of no more pairs than this are compared outright; so the smaller side has 16,384 rows at most.
OUTRIGHT = 1 << 28


def most_similar(readings: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """The entry with the most similar key to any reading of a row, over 0: ``keys``, roster_id, near_score.

    Of equals the first reading, then the first roster form. Names are looked up
    in rounds, each with a lower bar: one whose best form is above the bar is
    done. As soon as the pairs of what is left are few, they are compared outright.
    Forms of less than half a name are found by letters in order, and the
    last ones by a single letter and its place.
    """
    left = readings.where("key != ''").select(*keys, "pos", "key")
    right = forms.where("key != ''").groupBy(F.col("key").alias("form_key")).agg(F.min_by("roster_id", "ix_pos").alias("roster_id"), F.min("ix_pos").alias("ix_pos"))
    right, todo, done = hold(right), hold(left.select("key").distinct()), []
    n_forms = right.count()
    for least in ROUNDS + LOOSE_ROUNDS:
        n = todo.count()
        if n * n_forms <= OUTRIGHT:
            if n * n_forms:
                done.append(hold(best_of_all(todo, n, right, n_forms)))
            break
        pairs = alike_pairs(todo, right, least) if least in ROUNDS else loose_pairs(todo, right, least)
        best = pairs.select("key", F.struct("s", (-F.col("ix_pos")).alias("back"), "roster_id").alias("b"))
        if least == LOOSE_ROUNDS[-1]:
            best = best.unionByName(one_letter_best(todo, right).select("key", F.struct("s", "back", "roster_id").alias("b")))
        done.append(hold(best.groupBy("key").agg(F.max("b").alias("b")).select("key", "b.*")))
        if least != LOOSE_ROUNDS[-1]:
            todo = hold(meet(todo, done[-1], "key", "left_anti"))
    found = right.select(F.col("form_key").alias("key"), F.lit(1.0).alias("s"), (-F.col("ix_pos")).alias("back"), "roster_id").limit(0)
    for part in done:
        found = found.unionByName(part)
    top = F.max_by(F.struct("roster_id", "s"), F.struct("s", -F.col("pos"), "back"))
    return meet(left, found, "key").groupBy(*keys).agg(top.alias("b")).select(*keys, "b.roster_id", F.col("b.s").alias("near_score"))


def resolve(rows: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, keys: tuple[str, ...] = ("board_id", "gid")) -> DataFrame:
    """Consolidated rows (``keys``, name, plain, obs, claims) with roster_id, search, ingame, alliance, via, score, near_id and near_score.

    Tiers: a correction in ``aliases`` (alias_key, name, alliance) of the row's
    name that is on the roster; a reading that is one entry's name alone; a claim
    that a reading makes plausible (of twins the first); then the first reading
    that a ladder matches, by a correction (also to a name that isn't on the
    roster: no roster_id then), the first entry of that name, of those symbols, a
    near name, near symbols. A row that nothing matches stays, with nulls, ``via``
    '' and the most similar entry as a suggestion. Readings are ``obs``, or the
    name without any; null readings and claims are left out.
    """
    ids = list(keys)
    forms = hold(roster_forms(roster))  # every tier reads forms and readings
    said = F.when(F.size("obs") > 0, F.col("obs")).otherwise(F.array("name"))
    readings = rows.select(*ids, F.posexplode(said).alias("pos", "reading"))
    readings = hold(name_keys(readings.where("reading is not null and reading != ''"), "reading"))
    none = F.lit(None).cast("string")

    def hit(df: DataFrame, tier: int, pos: Column, rung: int = 0, name: Column = none, alliance: Column = none) -> DataFrame:
        found = F.struct(F.lit(tier).alias("tier"), pos.cast("long").alias("pos"), F.lit(rung).alias("rung"), F.col("roster_id").cast("long").alias("roster_id"), name.alias("free"), alliance.alias("free_alliance"))
        return df.select(*ids, found.alias("hit"))

    first = forms.where("key != ''").groupBy("key").agg(F.min_by("roster_id", "ix_pos").alias("first_id"), F.min("roster_id").alias("low"), F.max("roster_id").alias("high"))
    first = first.select(F.col("key").alias("fold"), "first_id", F.expr("if(low = high, low, null)").alias("sole_id"))
    signs = first_hit(readings.where("shown != ''"), forms.where("key = ''"), "shown")
    near, near_signs = near_names(readings, forms, [*ids, "pos"]), near_symbols(readings, forms, [*ids, "pos"])
    claims = rows.select(*ids, F.posexplode("claims").alias("claim_pos", "claim")).where("claim != ''")
    claimed = meet(claims.withColumn("fold", fold(F.col("claim"))), first, "fold").select(*ids, "claim_pos", F.coalesce("sole_id", "first_id").alias("roster_id"))
    shapes = forms.select("roster_id", F.col("key").alias("f_key"), F.col("shown").alias("f_shown"), F.col("exotic").alias("f_exotic"))
    plausible = claim_plausible(*[F.col(c) for c in ("key", "shown", "exotic", "f_key", "f_shown", "f_exotic")])
    pos = F.col("pos")
    hits = (
        hit(meet(readings, first.where("sole_id is not null"), "fold").withColumnRenamed("sole_id", "roster_id"), FOLD, pos)
        .unionByName(hit(meet(meet(claimed, shapes, "roster_id"), readings, ids).where(plausible), CLAIM, F.col("claim_pos")))
        .unionByName(hit(readings.where("key != ''").drop("fold").withColumnRenamed("key", "fold").transform(meet, first, "fold").withColumnRenamed("first_id", "roster_id"), LADDER, pos, FIRST))
        .unionByName(hit(signs, LADDER, pos, SYMBOL))
        .unionByName(hit(near, LADDER, pos, NEAR))
        .unionByName(hit(near_signs, LADDER, pos, NEAR_SYMBOL))
    )
    if aliases is not None:
        given = aliases.groupBy("alias_key").agg(F.max(F.struct("name", "alliance")).alias("alias")).select(F.col("alias_key").alias("any"), "alias.*")
        given = meet(given.withColumn("fold", fold(F.col("name"))), first, "fold", "left").select("any", "name", "alliance", F.coalesce("sole_id", "first_id").alias("roster_id"))
        own = rows.select(*ids, F.posexplode(F.array(F.when(F.coalesce("plain", F.lit("")) != "", F.col("plain")).otherwise(F.col("name")), F.col("name"))).alias("pos", "reading"))
        own = meet(own.withColumn("any", alias_key(F.col("reading"))).where("any != ''"), given, "any")
        # Of the row's two names the first that has a correction counts, on the roster or not.
        own = own.groupBy(*ids).agg(F.min_by("roster_id", "pos").alias("roster_id")).where("roster_id is not null")
        free = lambda c: F.when(F.col("roster_id").isNull(), F.coalesce(c, F.lit("")))
        of_readings = meet(readings.where("any != ''"), given, "any")
        hits = hits.unionByName(hit(own, ALIAS, F.lit(0))).unionByName(hit(of_readings, LADDER, pos, FREE, free(F.col("name")), free(F.col("alliance"))))
    found = hold(hits.groupBy(*ids).agg(F.min("hit").alias("hit"))).select(*ids, "hit.tier", "hit.rung", "hit.roster_id", "hit.free", "hit.free_alliance")

    suggested = most_similar(meet(readings, found, ids, "left_anti"), forms, ids).withColumnRenamed("roster_id", "near_id")
    names = roster.select("roster_id", "search", "ingame", "alliance")
    out = meet(meet(meet(rows, found, ids, "left"), names, "roster_id", "left"), suggested, ids, "left")
    word = lambda words, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col(c))
    out = out.withColumn("via", F.coalesce(F.when(F.col("tier") == LADDER, word(RUNG_VIA, "rung")).otherwise(word(VIA, "tier")), F.lit("")))
    out = out.withColumns({"search": F.coalesce("search", "free"), "ingame": F.coalesce("ingame", "free"), "alliance": F.coalesce("alliance", "free_alliance")})
    score = F.when(F.col("tier").isNotNull(), 1.0).otherwise(F.coalesce("near_score", F.lit(0.0)))
    return out.withColumn("score", score).drop("tier", "rung", "free", "free_alliance")


def drop_conflicts(df: DataFrame, by: str = "board_id", key: str = "roster_id", guest: str = "search", clear: tuple[str, ...] = ("roster_id", "search", "ingame", "alliance")) -> DataFrame:
    """Entries that two rows of a board claim are trusted in neither: their match is cleared and their score 0.

    A row corrected to a name off the roster claims that name (``guest``), by its
    letters or else its symbols. Counts are aggregated before they are joined
    back; ``via`` stays.
    """
    claim = F.concat(F.lit("#"), F.col(key).cast("string"))
    if guest in df.columns:
        claim = F.coalesce(claim, F.nullif(F.concat(F.lit("="), alias_key(F.coalesce(guest, F.lit("")))), F.lit("=")))
    rows = df.withColumn("_claim", claim)
    twice = rows.where("_claim is not null").groupBy(by, "_claim").agg(F.count("*").alias("_n")).where("_n > 1")
    out = rows.join(twice, [by, "_claim"], "left")
    bad = F.col("_n").isNotNull()
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cleared = {c: F.when(bad, F.lit(None).cast(kinds[c])).otherwise(F.col(c)) for c in clear if c in kinds}
    if "score" in kinds:
        cleared["score"] = F.when(bad, 0.0).otherwise(F.col("score"))
    return out.withColumns(cleared).select(*df.columns)
