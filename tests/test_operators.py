"""Linkage, consolidation, sheets, answers and sampling on small hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from boardflow.functions.similarity import similarity, symbols_near, within_one_edit
from boardflow.functions.text import MORE_LETTERS, NO_LETTERS, exoticness, fold, fold_text, symbols, usable_fold
from boardflow.operators import analysis, sampling, sheet
from boardflow.operators.clean import drop_foreign_rows, upper_median
from boardflow.operators.consolidate import consolidate, peak_mode, tally
from boardflow.operators.ranks import fill_ranks, missing_ranks
from boardflow.operators.resolve import drop_conflicts, most_similar, resolve
from boardflow.plans.names import resolution_ladder
from boardflow.sources.replies import parse_replies, read_batches, reply_status, sheet_head
from boardflow.streaming import boards
from boardflow.streaming.boards import keep_boards, rolling_totals, update_boards

NAMES = [
    ("ŊŲƁĮ", "nubi", "nubi", 1.0, 4),
    ("DUBI", "dubi", "dubi", 0.0, 4),
    ("ḐUBĮ", "dubi", "dubi", 0.5, 4),
    ("กUBI", "ubi", "ubi", 0.25, 4),
    ("𝓡𝓑𝓙", "rbj", "rbj", 1.0, 3),
    ("ΛƧƬΛ♣️", "st", "", 1.0, 5),
    ("🐻‍❄️", "", "", 1.0, 2),
    ("MEOW²", "meow2", "meow2", 0.2, 5),
    ("Killua swords", "killuaswords", "killuaswords", 0.0, 12),
]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n, *_ in NAMES] + [(None,)], "n string")
    c = F.col("n")
    got = df.select("n", fold(c), usable_fold(c), exoticness(F.coalesce(c, F.lit(""))), F.char_length(symbols(c))).collect()
    assert [tuple(r) for r in got[:-1]] == [pytest.approx(x) if isinstance(x, float) else x for x in NAMES]
    assert tuple(got[-1]) == (None, "", "", 0.0, 0)


def test_edits(spark):
    df = spark.createDataFrame([("weezy", "peezy"), ("minime", "mexialt"), ("", ""), ("", "a")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(F.round(similarity(a, b), 3).alias("s"), within_one_edit(a, b).alias("one"), symbols_near(a, b).alias("near")).collect()
    assert [(r.s, r.one, r.near) for r in got] == [(0.8, True, True), (0.286, False, False), (1.0, True, True), (0.0, True, True)]


def test_replies(spark):
    text = '[{"rank":"#4","seen":"Ann","roster_name":"","points":"1,200"},{"rank":5,"seen":"","roster_name":"Bo","points":12.7},{"rank":"6","seen":"Cy","points":"none"},{"rank":"7","seen'
    df = spark.createDataFrame([(1, 0, text), (1, 1, "[]"), (1, 2, "sorry"), (1, 3, None)], "board_id long, batch int, text string")
    assert [r.status for r in reply_status(df).orderBy("batch").collect()] == ["rows", "empty", "garbage", "garbage"]
    assert [(r.seq, r.rank, r.name, r.points) for r in parse_replies(df).orderBy("seq").collect()] == [(0, 4, "Ann", 1200.0), (1, 5, "Bo", 12.7)]


def test_foreign_rows_need_eight_scores(spark):
    few = [("a", 1, float(p)) for p in (1, 2, 3, 10, 900)]
    many = [("b", None, float(p)) for p in (1, 1, 1, 1, 1, 2, 2, 8, 9, 0)] + [("b", 3, 0.0)]
    df = spark.createDataFrame(few + many, "board_id string, rank int, points double")
    got = sorted((r.board_id, r.points, r["rank"] or 0) for r in drop_foreign_rows(df).collect())
    assert [x[:2] for x in got if x[0] == "a"] == [("a", p) for p in (1.0, 2.0, 3.0, 10.0, 900.0)]
    assert sorted(x[1] for x in got if x[0] == "b") == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 8.0]


def test_peak_mode_and_rank_fill(spark):
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate("baba")], "g int, v string, i int")
    assert peak_mode(df, ["g"], "v", "i").first()["mode"] == "b"
    ranks = spark.createDataFrame([(1, i, r) for i, r in enumerate([5, 0, 2, 0, 9])], "g int, i int, r int")
    assert [r.place for r in fill_ranks(ranks, ["g"], ["i"], "r").orderBy("i").collect()] == [5, 6, 2, 7, 9]


SIGHTINGS = [  # seq, rank, points, name, roster_name
    (0, 1, 100.0, "Anna", "Anna"), (1, 1, 100.0, "Anne", ""), (2, 2, 90.0, "Bo", ""), (3, None, 100.0, "Annaa", ""),
    (4, None, 70.0, "Zed", ""), (5, None, 70.0, "Zedd", "Zed"), (6, None, 70.0, "Qqqqqq", ""), (7, 1, 101.0, "Anna", "Anna"),
    (8, None, 60.0, "🐻", ""), (9, None, 60.0, "🐼", ""),
]


def sightings(spark):
    rows = [("b", s, r, p, n, n, c) for s, r, p, n, c in SIGHTINGS]
    return spark.createDataFrame(rows, "board_id string, seq long, rank long, points double, name string, plain string, roster_name string")


def test_consolidate(spark):
    got = {r.name: r for r in consolidate(sightings(spark)).collect()}
    assert set(got) == {"Anna", "Bo", "Zed", "Qqqqqq", "🐻", "🐼"}
    anna = got["Anna"]
    assert (anna.points, anna.seen, anna.obs, anna.claims, anna.pick_, anna["rank"]) == (100.0, 4, ["Anna", "Anne", "Annaa"], ["Anna"], "Anna", 1)
    assert (got["Zed"].seen, got["Zed"].claims) == (2, ["Zed"])


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    rows = sightings(spark)
    half = rows.withColumn("half", F.col("seq") % 2)
    for i in (0, 1):
        half.where(F.col("half") == i).drop("half").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_boards(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    key = lambda df: sorted((r.name, r.points, r.seen, tuple(r.obs)) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(consolidate(rows))


def test_batches_are_planned_adaptively_and_leave_no_state_in_executors(spark, tmp_path, monkeypatch):
    planned = []

    def seen(tallies, *more, **options):
        planned.append(tallies.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return update_boards(tallies, *more, **options)

    monkeypatch.setattr(boards, "update_boards", seen)
    rows = sightings(spark)
    parts = [rows, rows.withColumn("seq", F.col("seq") + 100), rows.withColumn("seq", F.col("seq") + 200)]
    for part in parts:  # the same readings come in each, and the stream starts again
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        keep_boards(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    key = lambda df: sorted((r.name, r.points, r.seen, tuple(r.obs), r.group_pos) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(consolidate(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    assert planned == ["true"] * 3
    assert not (tmp_path / "check" / "state").exists()


def test_batches_of_a_stream_run_again_and_keep_only_distinct_readings(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    rows = sightings(spark)
    more = rows.unionByName(rows.withColumn("seq", F.col("seq") + 100)).unionByName(rows.withColumn("seq", F.col("seq") + 200))
    key = lambda df: sorted((r.board_id, r.name, r.points, r.seen, tuple(r.obs)) for r in df.collect())
    so_far = lambda i: tally(more.where(F.col("seq") < 100 * (i + 1)))
    for i in (0, 1, 1, 2):  # as a driver that was lost runs them
        update_boards(so_far(i), i, store, out, buckets=4)
        stored = spark.read.parquet(f"{store}/batch={i}")
        assert stored.count() == tally(rows).count() and stored.agg(F.sum("n")).first()[0] == 10 * (i + 1)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if any(p.glob("bucket=*"))) == ["batch=1", "batch=2"]
    update_boards(so_far(2).limit(0), 3, store, out, buckets=4)  # an empty batch changes nothing
    assert key(spark.read.parquet(out)) == key(consolidate(more))


def test_medians_of_tallied_rows(spark):
    rows = spark.createDataFrame([("a", float(v), n) for v, n in ((1, 3), (2, 9000), (5, 2), (7, 9001), (100, 4))], "g string, v double, n long")
    each = rows.select("g", "v", F.explode(F.expr("sequence(1, n)"))).select("g", "v")
    assert [tuple(r) for r in upper_median(rows, "g", "v", few=64, times="n").collect()] == [tuple(r) for r in upper_median(each, "g", "v").collect()]


def test_fields_of_many_sheets(spark):
    heads = [["Rank", " Player  ", None, "score", "Total points"], [], None, ["Search rank", "Rank", "name", "day 3", "Day"], ["", "#", "Game  Name", "CLAN"]]
    df = spark.createDataFrame(list(enumerate(heads)), "id int, headings array<string>")
    got = {r.id: r for r in sheet.guess_fields_of(df).collect()}
    for i, h in enumerate(heads):
        mapping = sheet.guess_fields(h)
        assert got[i].fields == [field for _, field in mapping] and got[i].missing == sheet.unmapped(mapping)


def test_resolve(spark):
    roster = spark.createDataFrame(
        [(1, "Nubi", "", "N"), (2, "Peezy", "", "N"), (3, "🐻❄️", "", "S"), (4, "Longname", "Ŀøngname", "S"), (5, "Twin", "", "W"), (6, "twin", "", "W"), (7, "ᴀʟᴇxᴀɴᴅʀᴀ", "", "W")],
        "roster_id long, search string, ingame string, alliance string",
    )
    rows = [
        ("exact", "ŊŲƁĮ", [], None), ("near", "ḐUBĮ", [], None), ("plain", "DUBI", [], None), ("claim", "Weezy", ["Peezy"], None),
        ("bad claim", "Xxxxxx", ["Peezy"], None), ("sign", "🐻‍❄️", [], None), ("near sign", "🐼❄️", [], None), ("twins", "twin", [], None), ("alias", "Foo", [], None), ("guest", "Bar", [], None), ("empty", "", [], None),
    ]
    df = spark.createDataFrame([("b", g, n, n, [n], c) for g, n, c, _ in rows], "board_id string, gid string, name string, plain string, obs array<string>, claims array<string>")
    aliases = spark.createDataFrame([("foo", "Longname", "S"), ("bar", "Somebody", None)], "alias_key string, name string, alliance string")
    got = {r.gid: r for r in resolve(df, roster, aliases).collect()}
    assert {g: (r.search, r.via) for g, r in got.items()} == {
        "exact": ("Nubi", "name"),
        "near": ("Nubi", "near"),
        "plain": (None, ""),
        "claim": ("Peezy", "claim"),
        "bad claim": (None, ""),
        "sign": ("🐻❄️", "symbol"),
        "near sign": ("🐻❄️", "near symbol"),
        "twins": ("Twin", "first name"),
        "alias": ("Longname", "alias"),
        "guest": ("Somebody", "alias"),
        "empty": (None, ""),
    }
    assert got["plain"].near_id == 1 and got["plain"].near_score == 0.75
    assert (got["alias"].roster_id, got["alias"].ingame, got["alias"].alliance) == (4, "Ŀøngname", "S")
    assert (got["guest"].roster_id, got["guest"].ingame, got["guest"].alliance) == (None, "Somebody", "")
    both = rows[:1] + [("other", "Longname", [], None), ("alias", "Foo", [], None)]
    both = spark.createDataFrame([("b", g, n, n, [n], c) for g, n, c, _ in both], df.schema)
    kept = {r.gid: (r.roster_id, r.search, r.score, r.via) for r in drop_conflicts(resolve(both, roster, aliases)).collect()}
    assert kept == {"exact": (1, "Nubi", 1.0, "name"), "other": (None, None, 0.0, "name"), "alias": (None, None, 0.0, "alias")}
    kept = {r.gid: r.roster_id for r in drop_conflicts(resolve(df, roster)).collect()}
    assert kept["exact"] is None and kept["near"] is None and kept["claim"] == 2


@pytest.mark.parametrize(
    "headings, fields",
    [
        (["Place", "Searchable Name", "Game Name", "Alliance", "Points", "Date"], ["place", "search", "ingame", "alliance", "points", "date"]),
        (["#", "Name", "Game Name", "Team", "Score"], ["place", "search", "ingame", "alliance", "points"]),
        (["Rank", "Player", "Notes", "Points"], ["place", "search", None, "points"]),
        (["Points", "Score", "Total"], ["points", None, None]),
        (["", "  ", "Points"], [None, None, "points"]),
        (None, []),
    ],
)
def test_headings(headings, fields):
    assert [f for _, f in sheet.guess_fields(headings)] == fields


def test_sheet(spark):
    mapping = sheet.guess_fields(["Rank", "Name", "Other", "Score", "Date"])
    rows = spark.createDataFrame([(1, "Ann", 0.0, 0), (2, None, 5.0, 1)], "place long, search string, points double, index int")
    assert [tuple(r) for r in sheet.to_sheet(rows, mapping, {"date": "2024-05-01"}).collect()] == [("1", "Ann", "", "0.0", "2024-05-01"), ("2", "", "", "5.0", "2024-05-01")]
    assert sheet.key_headings(mapping, {"date": "x"}) == ["Name", "Date"] and sheet.key_headings(mapping) == ["Name"]
    assert sheet.unmapped(mapping) == ["ingame", "alliance"]
    old = spark.createDataFrame([(1, "  ANN "), (2, "ann"), (3, "")], "row int, search string")
    dupes = sheet.find_duplicates(rows, old, ["search"])
    assert [tuple(r) for r in dupes.collect()] == [(0, 1)]
    assert [r["index"] for r in sheet.keep_rows(rows, dupes).collect()] == [1]
    added = spark.createDataFrame([(1, "x"), (2, "y")], "row int, search string")
    wide = sheet.insert_rows(old, added, "w", before=2)
    assert [r.search for r in wide.orderBy("row").collect()] == ["  ANN ", "x", "y", "ann", ""]
    assert [r.search for r in sheet.insert_rows(old, added, "w").orderBy("row").collect()] == ["  ANN ", "ann", "", "x", "y"]
    assert tuple(sheet.write_receipt(wide, "w", "tab").first()) == (2, 2, 3, "tab")
    assert [(r.row, r.search) for r in sheet.undo(wide, "w").orderBy("row").collect()] == [(1, "  ANN "), (2, "ann"), (3, "")]


def test_written_answers():
    raw = {"answer": "The averages", "confidence": "low", "charts": [{"type": "bar", "x": "g", "y": "v", "data": [{"g": "A", "v": "275.46"}, {"g": "B", "v": 269.62}, {"g": "C"}]}], "metrics": [{"name": "N", "value": 3}, {"name": "none"}]}
    out = analysis.clean_analysis(raw)
    assert (out["summary"], out["confidence"]) == ("The averages", "inferred")
    assert [c["type"] for c in out["components"]] == ["metric", "bar_chart"]
    assert out["components"][1]["rows"] == [{"label": "A", "value": 275.46}, {"label": "B", "value": 269.62}]
    assert "{" not in analysis.clean_analysis(None, '{"x": 1')["summary"]
    assert analysis.extract_json("so:\n```json\n{\"a\": 1}\n```") == {"a": 1} and analysis.extract_json("x {\"a\": 2} y") == {"a": 2} and analysis.extract_json("no") is None
    made = analysis.clean_analysis({"summary": "s", "components": [{"type": "comparison", "rows": [{"player": "p", "before": 5, "after": "3"}]}, {"type": "line_chart", "series": [{"name": "a", "points": [{"x": 1, "y": 2}]}]}, {"type": "nope"}]})
    assert made["components"] == [{"type": "comparison", "rows": [{"label": "p", "before": 5, "after": 3.0, "change": -2.0}]}]
    json.dumps(made)


def test_ask(spark):
    df = spark.createDataFrame([("N", 1, 10.0), ("N", 2, 4.0), ("S", 1, 5.0), ("S", 2, None), (None, 1, 3.0)], "grp string, day int, points double")
    assert analysis.ask(df, "count")["components"][0][1].first()["value"] == 5
    answer = analysis.ask(df, "average", group="grp", value="points")
    kind, bars = answer["components"][0]
    assert kind == "bar_chart" and [tuple(r) for r in bars.collect()] == [("N", 7.0), ("S", 5.0)]
    assert answer["rowsRead"]() == 5
    change = analysis.ask(df, "change", label="grp", period="day", before=1, after=2, value="points")["components"][0][1]
    assert [tuple(r) for r in change.collect()] == [("N", 10.0, 4.0, -6.0)]
    with pytest.raises(ValueError):
        analysis.ask(df, "poem")


def test_sampling(spark):
    df = spark.createDataFrame([(1, t / 4, m) for t, m in enumerate([0.0, 1.0, 1.0, 4.0, 8.0])], "g int, t double, m double")
    assert sorted(r.t for r in sampling.equal_motion_picks(df, "g", "t", "m", 2).collect()) == [0.0, 0.75]
    assert [r.t for r in sampling.even_time_picks(df, "g", "t", 2).orderBy("k").collect()] == [0.25, 0.75]
    budget = spark.range(1).select(sampling.frame_budget(F.lit(13_320), F.lit(64)).alias("b")).first().b
    assert tuple(budget) == (55, 165) and sampling.batch_size(165) == 28
    assert sorted(r.t for r in sampling.picks_of(df, "g", "t", "m", 3).collect()) == [0.0, 0.5, 0.75, 1.0]
    assert sampling.batch_size(10) == 8 and sampling.batch_size(100) == 17 and sampling.batch_size(1000) == 40
    waits = spark.createDataFrame([("please retry in 12.5s",), ("try again in 300ms",), ("retry in 900s",), ("no",), ("HTTP 429 retry-after 3.2, retry in 8s",), (None,)], "m string")
    assert [r.w for r in waits.select(sampling.wait_seconds(F.col("m")).alias("w")).collect()] == [13.0, 1.0, 90.0, None, 4.0, None]
    cells = spark.createDataFrame([(1, c, 10.0 if c % 8 in (2, 3, 4) and c // 8 < 4 else 0.0) for c in range(64)], "g int, cell int, change double")
    box = sampling.moving_region(cells, "g", 8, 8).first()
    assert (round(box.x0, 3), box.y0, round(box.x1, 3), round(box.y1, 3)) == (0.244, 0.0, 0.631, 0.506)


def test_bars_keep_labels_with_a_common_head_apart(spark):
    head = "h" * 60
    df = spark.createDataFrame([(head + "/a", 1.0), (head + "/a", 3.0), (head + "/b", 10.0)], "url string, points double")
    for intent, want in (("average", [(head, 10.0), (head, 2.0)]), ("total", [(head, 10.0), (head, 4.0)])):
        _, bars = analysis.ask(df, intent, group="url", value="points")["components"][0]
        assert [tuple(r) for r in bars.collect()] == want


def test_fold_is_the_same_in_the_jvm_and_in_python(spark):
    points = [chr(c) for c in range(1, 0x1FFFF) if not 0xD800 <= c < 0xE000]
    texts = points[::7] + ["".join(points[i : i + 40]) for i in range(0, len(points), 40)] + list(MORE_LETTERS) + list(NO_LETTERS) + ["½™ﬁ ㎏ x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold(F.col("t")).alias("f")).collect()
    assert [(r.t, r.f) for r in got if r.f != fold_text(r.t)] == []
    assert all(fold_text(k) == v.lower() for k, v in MORE_LETTERS.items()) and not any(fold_text(c) for c in NO_LETTERS)


def test_every_rung_of_the_ladder_occurs(spark):
    found = {r.via for r in resolution_ladder(spark, "/root/testdata/sf0.01").select("via").distinct().collect()}
    assert found == {"", "alias", "name", "claim", "first name", "symbol", "near", "near symbol"}


def test_most_similar_by_pairs_and_by_characters(spark):
    df = spark.createDataFrame([(1, 0, "abcdef"), (2, 0, "xbydz"), (3, 0, "qqq"), (4, 0, "fedcba"), (4, 1, "abcdeg")], "k int, pos int, key string")
    forms = spark.createDataFrame([(7, 7, "abcdeg"), (8, 8, "dabc"), (9, 9, "tbudv")], "roster_id long, ix_pos long, key string")
    got = {r.k: (r.roster_id, round(r.near_score, 3)) for r in most_similar(df, forms, ["k"]).collect()}
    assert got == {1: (7, 0.833), 2: (9, 0.4), 4: (7, 1.0)}


def test_gaps_of_far_ranks_are_spelt_out_in_parts(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("a", 5), ("a", 0), ("a", None), ("b", 1)], "g string, r long")
    assert sorted((r.g, r.top, r.hole) for r in missing_ranks(df, "g", "r", at_once=1).collect()) == [("a", 5, 1), ("a", 5, 3), ("a", 5, 4)]
    far = spark.createDataFrame([("a", 1), ("a", 300_000)], "g string, r long")
    assert missing_ranks(far, "g", "r").count() == 299_998


def test_median_with_an_outlier(spark):
    values = [float(i) for i in range(1, 1002)] + [1e15, -5.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("c", 1.0), ("c", 2.0), ("d", -1.0)], "g string, v double")
    assert {(r.g, r.n, r.median) for r in upper_median(df, "g", "v").collect()} == {("a", 1002, 502.0), ("b", 1, 3.0), ("c", 2, 2.0)}


def test_orphans_lead_once_for_a_name(spark):
    rows = [("b", i, None, 5.0, n, n, "") for i, n in enumerate(["Anna", "Zzzzz", "Anna", "Anne", "Zzzzz"])]
    df = spark.createDataFrame(rows, "board_id string, seq long, rank long, points double, name string, plain string, roster_name string")
    assert {(r.gid, r.name, r.seen) for r in consolidate(df).collect()} == {("o0", "Anna", 3), ("o1", "Zzzzz", 2)}


def test_lines_are_in_the_order_of_their_own_type(spark):
    df = spark.createDataFrame([("a", x, 1.0) for x in range(1, 13)], "s string, x int, y double")
    assert [r.x for r in analysis.lines(df, F.col("s"), F.col("x"), F.sum("y"), points=3).collect()] == ["1", "2", "3"]


def test_missing_and_tables_of_answers(spark):
    have, want = spark.createDataFrame([("Änna",), ("Bo",)], "n string"), spark.createDataFrame([("ANNA",), ("Cy",), (" bo ",)], "n string")
    kind, rows = analysis.ask(have, "missing", expected=want, on="n")["components"][0]
    assert kind == "list" and [tuple(r) for r in rows.collect()] == [("Cy", "")]
    head, rows, total = sheet_head(spark.range(5).withColumnRenamed("id", "n"), "n", 2)
    assert (head, [r.n for r in rows.collect()]) == (["n"], [0, 1])
    assert total() == 5


def test_layout_and_output(spark):
    roster = spark.createDataFrame([(i, n) for i, n in enumerate(["★☆", "Plain", "ŊŲ", "  ", "♣♥", None, "ɳɳ", "♦"])], "roster_id long, ingame string")
    assert [(r.roster_id, r.line, r.place) for r in sheet.layout(roster, "ingame", ["roster_id"]).orderBy("roster_id").collect()] == [(0, 0, 0), (2, 0, 1), (4, 0, 2), (6, 0, 3), (7, 1, 0)]
    board = spark.createDataFrame([("b", 5.0, None, 7, "X", None, None, None), ("b", 9.0, 1, 3, "Y", "Yy", "", "A"), ("b", 5.0, 4, 9, "Z", "Zz", "zZ", "B")], "board_id string, points double, seenRank long, group_pos long, name string, search string, ingame string, alliance string")
    got = sorted(tuple(r) for r in sheet.output_rows(board).collect())
    assert got == [("b", 1, 1, "Yy", "Y", "A", 9.0), ("b", 2, 4, "Zz", "zZ", "B", 5.0), ("b", 3, 5, "", "X", "", 5.0)]


def test_audit_and_rolling_totals(spark, tmp_path):
    for line in ("wrote 2", "took back 2"):
        sheet.append_audit(line, spark, str(tmp_path / "audit"))
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == ["took back 2", "wrote 2"]
    events = spark.createDataFrame([("2024-01-01 00:00:05", "a", 2.0), ("2024-01-01 00:00:50", "a", 3.0), ("2024-01-01 00:01:10", "a", 4.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    got = {str(r.start)[11:]: (r.used, r.rows) for r in rolling_totals(events, "t", "k", "v").collect()}
    assert got["00:00:00"] == (5.0, 2) and got["00:00:20"] == (7.0, 2) and got["00:01:10"] == (4.0, 1)


def test_readers_are_tried_again_and_replaced(spark):
    def reader(content, prompt):
        if content == b"day":
            raise RuntimeError("429: quota per day used up")
        if content == b"bad":
            raise RuntimeError("try again in 0ms")
        return prompt + content.decode()

    def other(content, prompt):
        if content == b"bad":
            raise RuntimeError("no")
        return "other " + content.decode()

    df = spark.createDataFrame([("b", 0, b"x", "p:"), ("b", 1, b"day", "p:"), ("b", 2, b"bad", "p:")], "board_id string, batch int, content binary, prompt string")
    got = [(r.batch, r.text, r.error) for r in read_batches(df, reader, other, attempts=2, pause=0.0).orderBy("batch").collect()]
    assert got == [(0, "p:x", None), (1, "other day", None), (2, None, "no")]


def test_headings_are_tried_once_for_each_field(spark):
    heads = [["Rank", "search rank", None, "Day 2", "Score", "score"], [], None, ["Name", "In Game", "Clan", "#", "when"]]
    found = sheet.guess_fields_of(spark.createDataFrame(list(enumerate(heads)), "id long, headings array<string>"))
    for r in found.collect():
        want = sheet.guess_fields(heads[r.id])
        assert r.fields == [f for _, f in want] and r.missing == sheet.unmapped(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") == len(sheet.FIELDS)
