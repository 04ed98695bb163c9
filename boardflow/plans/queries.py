"""Queries over the driver's tables, and the SQL that gives the same rows.

Each applies one operator to a whole table; the tables hold no ranked lists, so
events stand in for readings, users for players and event types for boards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.functions.similarity import similarity
from boardflow.functions.text import decimal_number, exoticness, first_integer, fold, squeezed, usable_fold
from boardflow.operators import analysis, sampling, sheet
from boardflow.operators.clean import drop_foreign_rows, upper_median
from boardflow.operators.consolidate import consolidate, ordered_distinct, peak_mode
from boardflow.operators.ranks import fill_ranks, missing_ranks, review_counts, row_state, tally
from boardflow.operators.resolve import drop_conflicts, first_hit, most_similar, near_names, resolve, sole_owner
from boardflow.plans.registry import ORACLE_SQL, query
from boardflow.plans.registry import table as _table
from boardflow.sources.replies import parse_replies, reply_status, roster_of, sheet_lines

def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


# Parsing and cleaning


@query(
    f"""
SELECT event_id, {K_SQL} AS rank, event_type AS name, CAST(floor(value * 100) AS DOUBLE) AS points, 'rows' AS status FROM events WHERE event_id % 7 <> 0
UNION ALL
SELECT event_id, {K_SQL}, event_type, CAST(floor(value * 100) AS DOUBLE), 'rows' FROM events WHERE event_id % 7 = 0
"""
)
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of one whole reading and, in every seventh, one that is cut off."""
    whole = F.concat(F.lit('[{"rank": "#'), _k(), F.lit('", "roster_name": "", "seen": "'), "event_type", F.lit('", "points": "'), F.format_number(F.floor(F.col("value") * 100), 0), F.lit('"}'))
    text = F.when(F.col("event_id") % 7 == 0, F.concat(whole, F.lit(', {"rank": "7", "seen": "cut o'))).otherwise(F.concat(whole, F.lit("]")))
    replies = reply_status(_table(spark, sf_dir, "events").select(F.col("event_id").alias("board_id"), F.lit(0).alias("batch"), text.alias("text")))
    rows = parse_replies(replies).join(replies.select("board_id", "status"), "board_id")
    return rows.select(F.col("board_id").alias("event_id"), "rank", "name", "points", "status")


@query(
    """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value > 0 GROUP BY event_type)
SELECT event_type, len(v) AS n, v[len(v) // 2 + 1] AS median FROM s
"""
)
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_median(_table(spark, sf_dir, "events"), "event_type", "value")


@query(
    """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value > 0 GROUP BY event_type)
SELECT event_id, events.event_type, value FROM events LEFT JOIN s ON events.event_type = s.event_type
WHERE v IS NULL OR len(v) < 8 OR (value > 0 AND value <= 8 * v[len(v) // 2 + 1])
"""
)
def foreign_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_foreign_rows(_table(spark, sf_dir, "events"), "event_type", "value", None).select("event_id", "event_type", "value")


@query("SELECT doc_id, md5(regexp_replace(lower(strip_accents(replace(text, 'ß', 'b'))), '[^a-z0-9]', '', 'g')) AS folded FROM documents")
def fold_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.when(text.isNotNull(), F.md5(fold(text).cast("binary"))).alias("folded"))


@query(
    r"""
SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[\x00-\x20]', '', 'g')) > 0
  THEN CAST(length(regexp_replace(text, '[\x00-\x7E]', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '[\x00-\x20]', '', 'g')) ELSE 0 END, 9) AS share FROM documents
"""
)
def exotic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(exoticness(F.coalesce("text", F.lit(""))), 9).alias("share"))


@query(
    r"""
SELECT p_partkey, CAST(regexp_extract(p_brand, '\d+', 0) AS BIGINT) AS first_number, round(p_retailprice, 2) AS whole_number, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS heading FROM part
"""
)
def number_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first integer of a brand; prices written with commas and blanks read again; names as headings."""
    price = F.concat(F.lit(" "), F.format_number("p_retailprice", 2), F.lit(" "))
    return _table(spark, sf_dir, "part").select("p_partkey", first_integer(F.col("p_brand")).alias("first_number"), decimal_number(price).alias("whole_number"), squeezed(F.col("p_name")).alias("heading"))


# Grouping and ranks


@query(
    """
WITH c AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last) AS nth FROM c)
SELECT user_id, event_type AS mode FROM r WHERE nth = 1
"""
)
def first_to_peak_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_mode(_table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts")


@query(
    """
WITH f AS (SELECT user_id, event_type, min(ts) AS first FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, '|' ORDER BY first) AS kinds FROM f GROUP BY user_id
"""
)
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordered_distinct(_table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts")
    return found.select("user_id", F.array_join("found", "|").alias("kinds"))


@query(
    f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, CASE WHEN event_type IN ('click', 'error') THEN {K_SQL} END AS rank,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events
), w AS (
  SELECT event_id, user_id, i, CASE WHEN rank > 0 THEN rank ELSE 1 END AS place, greatest(CASE WHEN rank > 0 THEN rank ELSE 1 END, 0) AS n FROM e WHERE i = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.i, CASE WHEN e.rank > 0 THEN e.rank ELSE w.n + 1 END,
         greatest(CASE WHEN e.rank > 0 THEN w.n ELSE w.n + 1 END, CASE WHEN e.rank > 0 THEN e.rank ELSE 0 END)
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1
)
SELECT event_id, place FROM w
"""
)
def running_rank_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("rank", F.when(F.col("event_type").isin("click", "error"), _k()))
    return fill_ranks(rows, ["user_id"], ["ts"], "rank").select("event_id", "place")


@query(
    """
WITH t AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY l_orderkey),
g AS (SELECT l_orderkey, top, unnest(range(1, top + 1)) AS hole FROM t)
SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.hole)
"""
)
def rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_ranks(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    """
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first) AS nth FROM c) WHERE nth = 1
"""
)
def most_frequent_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(_table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query(
    """
SELECT o_orderpriority, count(*) FILTER (o_totalprice <= 100000 AND o_orderstatus = 'O') AS matched,
       count(*) FILTER (o_totalprice <= 100000 AND o_orderstatus <> 'O') AS fresh, count(*) FILTER (o_totalprice > 100000) AS dupes
FROM orders GROUP BY o_orderpriority
"""
)
def review_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = row_state(F.col("o_totalprice") > 100000, F.when(F.col("o_orderstatus") == "O", "on the roster"))
    return review_counts(_table(spark, sf_dir, "orders").withColumn("state", state), "o_orderpriority")


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a reading: its type a board, ``k`` + 1 the rank, the whole value the score, the user the name."""
    name = F.concat(F.lit("Player "), F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("board_id"),
        F.col("event_id").alias("seq"),
        (_k() + 1).alias("rank"),
        F.floor("value").cast("double").alias("points"),
        name.alias("name"),
        name.alias("plain"),
        F.lit("").alias("roster_name"),
    )


@query(
    f"""
WITH s AS (
  SELECT event_type AS board_id, event_id AS seq, {K_SQL} + 1 AS rank, floor(value) AS points, 'Player ' || user_id AS name FROM events
), m AS (
  SELECT board_id, list_sort(list(points)) AS v FROM s WHERE points > 0 GROUP BY board_id
), k AS (
  SELECT s.* FROM s LEFT JOIN m ON s.board_id = m.board_id WHERE v IS NULL OR len(v) < 8 OR points <= 0 OR points <= 8 * v[len(v) // 2 + 1]
), p AS (
  SELECT board_id, rank, points, row_number() OVER (PARTITION BY board_id, rank ORDER BY count(*) DESC, max(seq)) AS nth FROM k GROUP BY board_id, rank, points
), n AS (
  SELECT board_id, rank, name, row_number() OVER (PARTITION BY board_id, rank ORDER BY count(*) DESC, max(seq)) AS nth, min(seq) AS first FROM k GROUP BY board_id, rank, name
), o AS (
  SELECT board_id, rank, string_agg(name, '|' ORDER BY first) AS readings FROM n GROUP BY board_id, rank
)
SELECT p.board_id, p.rank AS place, p.points, n.name, o.readings, (SELECT count(*) FROM k WHERE k.board_id = p.board_id AND k.rank = p.rank) AS seen
FROM p JOIN n ON n.board_id = p.board_id AND n.rank = p.rank AND n.nth = 1 JOIN o ON o.board_id = p.board_id AND o.rank = p.rank WHERE p.nth = 1
"""
)
def consolidated_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without those of other lists, one row a place, ranks filled."""
    board = consolidate(drop_foreign_rows(_sightings(spark, sf_dir)))
    placed = fill_ranks(board, ["board_id"], [F.desc("points"), "seenRank", "group_pos"], "seenRank")
    return placed.select("board_id", "place", "points", "name", F.array_join("obs", "|").alias("readings"), "seen")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated_board(spark, sf_dir)


# Linkage


@query("SELECT p_partkey, p_name, round(CASE WHEN p_name = p_type THEN 1 ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END, 9) AS likeness FROM part")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", "p_name", F.round(similarity(F.col("p_name"), F.col("p_type")), 9).alias("likeness"))


def _part_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("roster_id"), F.col("p_partkey").alias("ix_pos"), usable_fold(F.concat_ws(" ", "p_name", "p_brand", "p_size")).alias("key"))


PART_KEY = "regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_size), '[^a-z0-9]', '', 'g')"


@query(f"SELECT {PART_KEY} AS key, min(p_partkey) AS roster_id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1")
def sole_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sole_owner(_part_forms(spark, sf_dir), "key")


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) AS roster_id FROM part")
def first_hit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _table(spark, sf_dir, "part").select("p_partkey", fold(F.col("p_name")).alias("key"))
    forms = keyed.select(F.col("p_partkey").alias("roster_id"), F.col("p_partkey").alias("ix_pos"), "key")
    return first_hit(keyed, forms, "key").select("p_partkey", "roster_id")


@query(
    """
WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, min(p_partkey) AS roster_id FROM part GROUP BY 1)
SELECT a.roster_id AS p_partkey, min(b.roster_id) AS roster_id FROM k a JOIN k b ON length(a.key) > 4 AND length(b.key) >= 4 AND levenshtein(a.key[2:], b.key) <= 1
GROUP BY a.roster_id HAVING count(DISTINCT b.roster_id) = 1
"""
)
def near_match_sole_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stylised names with their first letter left out, against the names: within one edit of exactly one."""
    name = F.col("p_name")
    keyed = _table(spark, sf_dir, "part").groupBy(fold(name).alias("key")).agg(F.min("p_partkey").alias("roster_id"))
    readings = keyed.select(F.col("roster_id").alias("p_partkey"), F.expr("substring(key, 2)").alias("key"), F.lit(1.0).alias("exotic"))
    return near_names(readings, keyed, ["p_partkey"])


@query(
    """
WITH a AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name FROM part),
b AS (SELECT regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS form, min(p_partkey) AS roster_id FROM part GROUP BY 1),
s AS (SELECT name, roster_id, 1 - levenshtein(name, form)::DOUBLE / greatest(length(name), length(form)) AS s FROM a, b)
SELECT name, roster_id, round(s, 9) AS near_score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, roster_id) AS nth FROM s WHERE s > 0) WHERE nth = 1
"""
)
def most_similar_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part name the most similar part type."""
    part = _table(spark, sf_dir, "part")
    names = part.select(fold(F.col("p_name")).alias("name")).distinct().select("name", F.col("name").alias("key"), F.lit(0).alias("pos"))
    forms = part.select(F.col("p_partkey").alias("roster_id"), F.col("p_partkey").alias("ix_pos"), fold(F.col("p_type")).alias("key"))
    return most_similar(names, forms, ["name"]).withColumn("near_score", F.round("near_score", 9))


@query(
    """
SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_orderpriority, o_custkey) = 1 THEN o_custkey END AS roster_id FROM orders
"""
)
def conflict_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that two orders of a priority name are kept by neither."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("roster_id"))
    return drop_conflicts(rows, "o_orderpriority").select("o_orderkey", "roster_id")


@query(
    """
WITH r AS (SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key FROM supplier),
o AS (SELECT key, min(s_suppkey) AS roster_id FROM r GROUP BY key HAVING count(*) = 1),
u AS (SELECT user_id, count(*) AS seen FROM events GROUP BY user_id)
SELECT user_id, seen, roster_id, CASE WHEN roster_id IS NULL THEN '' ELSE 'name' END AS via
FROM u LEFT JOIN o ON o.key = 'supplier' || lpad(CAST(user_id AS VARCHAR), 9, '0')
"""
)
def roster_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, read as supplier names in another style, against the suppliers as roster."""
    roster = roster_of(_table(spark, sf_dir, "supplier").withColumn("none", F.lit("")), "s_name", "none", "none", "s_suppkey")
    name = F.concat(F.lit("SUPPLIER  #"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    users = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("seen"))
    rows = users.select("user_id", "seen", name.alias("name"), name.alias("plain"), F.array(name).alias("obs"), F.array().cast("array<string>").alias("claims"))
    return resolve(rows, roster, keys=("user_id",)).select("user_id", "seen", "roster_id", "via")


# Sheets


@query(
    """
WITH k AS (SELECT doc_id, coalesce(nullif(regexp_replace(lower(strip_accents(replace(text, 'ß', 'b'))), '[^a-z0-9]', '', 'g'), ''), trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS k FROM documents)
SELECT doc_id AS index, min(doc_id) OVER (PARTITION BY k) AS row FROM k WHERE k <> ''
"""
)
def duplicate_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in capitals and with wider spaces, with the first one that shows the same."""
    docs = _table(spark, sf_dir, "documents")
    loud = F.replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), F.lit("  "))
    rows = docs.select(F.col("doc_id").alias("index"), loud.alias("text"))
    return sheet.find_duplicates(rows, docs.select(F.col("doc_id").alias("row"), "text"), ["text"])


@query(
    """
SELECT '' || c_custkey AS "Place", c_name AS "Name", '' AS "Notes", c_mktsegment AS "Team", c_nationkey || '' AS "Points", '2024-01-01' AS "Date" FROM customer
"""
)
def sheet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("search"), F.lit(None).cast("string").alias("ingame"), F.col("c_mktsegment").alias("alliance"), F.col("c_nationkey").alias("points"))
    return sheet.to_sheet(rows, sheet.guess_fields(["Place", "Name", "Notes", "Team", "Points", "Date"]), {"date": "2024-01-01"})


@query(
    """
SELECT CASE WHEN n_nationkey + 1 >= 4 THEN n_nationkey + 1 + (SELECT count(*) FROM region) ELSE n_nationkey + 1 END AS row, n_name AS name, '' || n_regionkey AS grp, NULL AS write_id FROM nation
UNION ALL SELECT r_regionkey + 4, r_name, '', 'w1' FROM region
"""
)
def sheet_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions inserted before row 4 of the nations."""
    old = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("row"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp"))
    new = _table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("row"), F.col("r_name").alias("name"))
    return sheet.insert_rows(old, new, "w1", before=4)


@query("SELECT n_nationkey + 1 AS row, n_name AS name, '' || n_regionkey AS grp FROM nation")
def sheet_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet.undo(sheet_insert(spark, sf_dir), "w1").drop("write_id")


@query("SELECT r_regionkey || ' | ' || trim(r_name) AS line FROM region")
def sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_lines(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


# Answers


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation and year."""
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "o_custkey", "c_name", "n_name", "o_totalprice", "o_orderdate", F.year("o_orderdate").alias("year"))


ORDERS_SQL = "(SELECT *, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(f"SELECT n_name AS label, round(avg(o_totalprice), 4) AS value FROM {ORDERS_SQL} GROUP BY n_name")
def average_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.bars(_orders(spark, sf_dir), F.col("n_name"), F.round(F.avg("o_totalprice"), 4))


@query(f"SELECT n_name AS series, '' || year AS x, round(sum(o_totalprice), 2) AS y FROM {ORDERS_SQL} WHERE n_name IN (SELECT n_name FROM (SELECT n_name, count(DISTINCT year) AS n FROM {ORDERS_SQL} GROUP BY 1 HAVING n > 1 ORDER BY n DESC, n_name LIMIT 6)) GROUP BY 1, 2")
def totals_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.lines(_orders(spark, sf_dir), F.col("n_name"), F.col("year"), F.round(F.sum("o_totalprice"), 2))


@query(
    f"""
WITH p AS (SELECT n_name AS label, round(sum(o_totalprice) FILTER (year = 1995), 2) AS before, round(sum(o_totalprice) FILTER (year = 1996), 2) AS after FROM {ORDERS_SQL} GROUP BY 1)
SELECT label, before, after, round(after - before, 2) AS change FROM p WHERE before IS NOT NULL AND after IS NOT NULL ORDER BY after - before, label LIMIT 10
"""
)
def largest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = analysis.comparison(_orders(spark, sf_dir), "n_name", "year", 1995, 1996, F.round(F.sum("o_totalprice"), 2))
    return analysis.most_changed(both, 10).withColumn("change", F.round("change", 2))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.ranking(_table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    """
WITH s AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders)
SELECT CAST(least(19, floor((o_totalprice - low) / (high - low) * 20)) AS INTEGER) AS bin, count(*) AS n FROM orders, s GROUP BY 1
"""
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", 20).select("bin", "n")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997)")
def who_is_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = _orders(spark, sf_dir).where("year = 1997")
    return analysis.missing_from(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), present, "c_name")


@query("SELECT 'Orders' AS label, count(*) AS value, '' AS unit FROM orders")
def single_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.metric(_table(spark, sf_dir, "orders"), F.count("*"), "Orders")


@query("SELECT count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS excluded FROM customer")
def groups_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.known_groups(_table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])[1]


# Sampling over time


SECONDS_SQL = "epoch_us(ts) / 1e6"


def _seconds() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


@query(
    """
WITH d AS (SELECT event_id, user_id, ts, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)), 0) AS d FROM events)
SELECT event_id, round(sum(d) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS motion FROM d
"""
)
def running_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.motion_total(_table(spark, sf_dir, "events"), "user_id", "ts", "value").select("event_id", F.round("motion", 4).alias("motion"))


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events with a running motion in whole cents, so that sums and eighths are exact."""
    rows = _table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return sampling.motion_total(rows, "user_id", "ts", "cents")


def equal_motion_sql(picks: int) -> str:
    return f"""
RECURSIVE d AS (
  SELECT user_id, ts, coalesce(abs(CAST(round(value * 100) AS BIGINT) - lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts)), 0) AS d FROM events
), m AS (
  SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY ts) AS DOUBLE) AS motion,
         CASE WHEN sum(d) OVER (PARTITION BY user_id) > 1e-6 THEN CAST(sum(d) OVER (PARTITION BY user_id) AS DOUBLE) / {picks} END AS gap FROM d
), p AS (
  SELECT user_id, ts, i, true AS picked, 1 AS n, motion + gap AS want FROM m WHERE i = 1
  UNION ALL
  SELECT m.user_id, m.ts, m.i, coalesce(m.motion >= p.want, false) AND p.n < {picks}, p.n + CASE WHEN coalesce(m.motion >= p.want, false) AND p.n < {picks} THEN 1 ELSE 0 END,
         CASE WHEN coalesce(m.motion >= p.want, false) AND p.n < {picks} THEN m.motion + m.gap ELSE p.want END
  FROM p JOIN m ON m.user_id = p.user_id AND m.i = p.i + 1
)"""


@query(f"WITH {equal_motion_sql(8)} SELECT user_id, ts FROM p WHERE picked")
def equal_motion_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, and those at which another eighth of the motion has passed."""
    return sampling.equal_motion_picks(_cents(spark, sf_dir), "user_id", "ts", "motion", 8)


@query(
    f"""
WITH e AS (SELECT user_id, {SECONDS_SQL} - 1704067200 AS t FROM events),
w AS (SELECT user_id, k, (k + 0.5) / 4 * max(t) AS want FROM e, (SELECT unnest(range(4)) AS k) GROUP BY user_id, k)
SELECT user_id, k, round(t, 6) AS t FROM (SELECT w.user_id, k, t, row_number() OVER (PARTITION BY w.user_id, k ORDER BY abs(t - want), t) AS nth FROM w JOIN e ON e.user_id = w.user_id) WHERE nth = 1
"""
)
def even_time_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", (_seconds() - 1704067200).alias("t"))
    return sampling.even_time_picks(rows, "user_id", "t", 4).withColumn("t", F.round("t", 6))


@query(
    f"""
WITH e AS (SELECT event_id, user_id, {SECONDS_SQL} AS t FROM events)
SELECT event_id, round(least(0.2, 0.25 * (t - lag(t) OVER w), 0.25 * (lead(t) OVER w - t)), 6) AS reach FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)
"""
)
def neighbour_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("t", _seconds())
    return sampling.neighbour_reach(rows, "user_id", "t").select("event_id", F.round("reach", 6).alias("reach"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW), 4) AS used FROM events")
def rolling_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.rolling_sum(_table(spark, sf_dir, "events"), "event_type", "ts", "value")
    return out.select("event_id", F.round("used", 4).alias("used"))


@query("SELECT part.p_partkey, band, greatest(0.0, (band - 0.25) * p_size / 3.0) AS low, least(CAST(p_size AS DOUBLE), (band + 1.25) * p_size / 3.0) AS high FROM part, (SELECT unnest(range(3)) AS band)")
def overlapping_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = sampling.overlapping_bands(F.lit(0.0), F.col("p_size").cast("double"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.inline(bands))
    return rows.select("p_partkey", "band", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


ORACLE_SQL["overlapping_bands"] = f"SELECT p_partkey, band, round(low, 9) AS low, round(high, 9) AS high FROM ({ORACLE_SQL['overlapping_bands']})"


@query(
    """
SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)
  / least(40, greatest(8, ceil(count(*) OVER (PARTITION BY o_orderpriority) / 6.0)))) AS BIGINT) AS batch FROM orders
"""
)
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batched(_table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "batch")


@query(
    """
WITH d AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT label, unnest(range(len(embedding))) AS cell, unnest(embedding)::DOUBLE AS x, unnest(b)::DOUBLE AS y FROM d WHERE b IS NOT NULL)
SELECT label, CAST(cell AS INTEGER) AS cell, round(sum(abs(x - y)), 3) AS change FROM c GROUP BY ALL
"""
)
def cell_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("grid"))
    return sampling.cell_changes(rows, "label", "vec_id", "grid").select("label", "cell", F.round("change", 3).alias("change"))
