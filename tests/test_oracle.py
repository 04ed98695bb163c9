"""Every query of the reference's operators against its SQL, on the small tables."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import pytest

from boardflow.plans import names  # noqa: F401
from boardflow.plans.queries import flagship
from boardflow.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert sorted(got.columns) == sorted(names)
    got = got.collect()
    assert want, "an empty result shows nothing"
    assert rows_of(list(got[0].__fields__) if got else names, got) == rows_of(names, want)


def test_flagship(spark):
    assert flagship(spark, "/root/testdata/sf0.001").count() > 0
