"""Committed writes, inserts, undo and recovery of a sheet on shared storage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from boardflow.sources.sheet_store import SheetStore, spans


def store(spark, tmp_path):
    return SheetStore(spark, f"file://{tmp_path}/sheet", ["Name", "Total points"])


def rows(spark, *names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "at int, Name string")


def names(sheet, upto=None):
    return [r.Name for r in sheet.read(upto).orderBy("row").collect()]


def test_writes_inserts_and_undo(spark, tmp_path):
    sheet = store(spark, tmp_path)
    assert names(sheet) == [] and sheet.history().count() == 0
    assert sheet.write(rows(spark, "a", "b", "c"), ["at"], write_id="w1") == {"write_id": "w1", "written": 3, "from": 1, "to": 3}
    assert sheet.write(rows(spark, "x", "y"), [F.desc("at")], before=2, write_id="w2", label="insert") == {"write_id": "w2", "written": 2, "from": 2, "to": 3}
    assert names(sheet) == ["a", "y", "x", "b", "c"]
    assert [r.row for r in sheet.read().orderBy("row").collect()] == [1, 2, 3, 4, 5]
    assert {r["Total points"] for r in sheet.read().collect()} == {""}
    assert sheet.write(rows(spark, "z"), ["at"], before=99, write_id="w3")["from"] == 6
    assert sheet.undo("w1") == 3 and names(sheet) == ["y", "x", "z"]
    assert sheet.undo("w1") == 0 and sheet.undo("never") == 0
    assert sheet.receipt("w2") == {"write_id": "w2", "written": 2, "from": 1, "to": 2}
    assert names(sheet, upto=2) == ["a", "y", "x", "b", "c"]
    assert [(r.number, r.kind, r.write_id, r.rows, r.label) for r in sheet.history().orderBy("number").collect()] == [(0, "write", "w1", 3, ""), (1, "write", "w2", 2, "insert"), (2, "write", "w3", 1, ""), (3, "undo", "w1", None, None)]


def test_a_write_that_is_run_again_counts_once(spark, tmp_path):
    sheet = store(spark, tmp_path)
    first = sheet.write(rows(spark, "a", "b"), ["at"], write_id="job-7")
    assert sheet.write(rows(spark, "a", "b"), ["at"], write_id="job-7") == first and names(sheet) == ["a", "b"]
    assert sheet.write(rows(spark).limit(0), ["at"], write_id="none") == {"write_id": "none", "written": 0, "from": None, "to": None}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    sheet = store(spark, tmp_path)
    sheet.write(rows(spark, "a"), ["at"])
    bad = rows(spark, "b", "c").withColumn("Total points", F.expr("if(at = 1, raise_error('lost'), 'ok')"))
    with pytest.raises(Exception, match="lost"):
        sheet.write(bad, ["at"], write_id="bad")
    assert names(sheet) == ["a"] and len(sheet.log()) == 1
    assert len(list((tmp_path / "sheet" / "rows").iterdir())) == 1


def test_rows_of_a_killed_writer_are_never_seen_and_swept(spark, tmp_path):
    sheet = store(spark, tmp_path)
    sheet.write(rows(spark, "a"), ["at"])
    spark.createDataFrame([(1, "half", "")], "place long, c0 string, c1 string").write.parquet(f"{sheet.path}/rows/killed-1")
    assert names(sheet) == ["a"]
    assert sheet.sweep() == 0 and sheet.sweep(older_than=-60) == 1
    assert names(sheet) == ["a"] and len(list((tmp_path / "sheet" / "rows").iterdir())) == 1


def test_a_taken_number_is_passed_over(spark, tmp_path, monkeypatch):
    """Two writers that saw the same log: the second takes the next number."""
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    a.write(rows(spark, "a"), ["at"], write_id="one")
    seen = b.log()
    a.write(rows(spark, "b"), ["at"], write_id="two")
    real = b.log
    monkeypatch.setattr(b, "log", lambda: seen)
    b._append({"kind": "undo", "write_id": "one", "at": 0.0})
    monkeypatch.setattr(b, "log", real)
    assert [e["write_id"] for e in a.log()] == ["one", "two", "one"] and names(a) == ["b"]


def test_places_follow_from_the_log():
    rng = random.Random(5)
    log, want = [], []
    for i in range(60):
        if log and rng.random() < 0.3:
            gone = f"w{rng.randrange(i)}"
            log.append({"kind": "undo", "write_id": gone})
            want = [x for x in want if x[0] != gone]
        else:
            n, before = rng.randint(0, 4), rng.choice([None, rng.randint(1, 30)])
            log.append({"kind": "write", "write_id": f"w{i}", "rows": n, "before": before})
            at = len(want) if before is None else min(before - 1, len(want))
            want[at:at] = [(f"w{i}", k) for k in range(1, n + 1)]
    assert [(w, k) for w, a, b in spans(log) for k in range(a, b + 1)] == want
