"""Queries against their SQL on keys as large as those of tables many times the size."""

from __future__ import annotations

import duckdb

from boardflow.operators.resolve import resolve
from boardflow.plans import names  # noqa: F401
from boardflow.plans.registry import ORACLE_SQL, QUERIES
from tests.test_oracle import rows_of


def same_as_sql(spark, folder, name, table, sql):
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns, want = [d[0] for d in want.description], want.fetchall()
    got = QUERIES[name](spark, str(folder))
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want) and want


def test_orphans_are_alike_whatever_their_numbers(spark, tmp_path):
    wide = "[0, 12345, 6789012345, 9223372036854770000]"
    sql = f"SELECT * REPLACE (user_id + {wide}[1 + event_id % 4] AS user_id) FROM '/root/testdata/sf0.001/events.parquet'"
    same_as_sql(spark, tmp_path, "orphans_attached", "events", sql)


def test_readings_in_signs_are_of_one_supplier(spark, tmp_path):
    # 5217 and 13557, 45957 and 57427, 25369 and 29837 have the same six signs
    sql = "SELECT s.* REPLACE (base + s_suppkey AS s_suppkey) FROM '/root/testdata/sf0.001/supplier.parquet' s, (SELECT unnest([5210, 13550, 25360, 29830, 45950, 57420]) AS base)"
    same_as_sql(spark, tmp_path, "resolution_ladder", "supplier", sql)


def test_of_entries_with_equal_signs_the_first_counts(spark):
    roster = spark.createDataFrame([(1, "★☆☀☁", "", "A"), (2, "★☆☀☁", "♔♕", "A")], "roster_id long, search string, ingame string, alliance string")
    rows = spark.createDataFrame([(k, name, name, [name], []) for k, name in [(1, "★☆☀☁"), (2, "♔♕")]], "k long, name string, plain string, obs array<string>, claims array<string>")
    found = resolve(rows, roster, keys=("k",)).collect()
    assert {(r.k, r.roster_id, r.via) for r in found} == {(1, 1, "symbol"), (2, 2, "symbol")}
