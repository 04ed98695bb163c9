"""The subpackage's SQL gives the rows of its queries; vectors also where they do link."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from boardflow.llm.embedding_dedup import near_duplicates
from boardflow.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import data


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data.SF}/{t}.parquet'")
    got = QUERIES[name](spark, data.SF)
    want = con.execute(ORACLE_SQL[name])
    assert by_name(got.columns, got.collect()) == by_name([d[0] for d in want.description], want.fetchall())


def test_sql_of_linked_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + 0.06 * rng.normal(size=16)], i % 2) for i in range(90)]
    rows += [(90, None, 0), (91, [0.0] * 16, 1), (92, [float("nan")] * 16, 1), (93, rows[0][1], None), (94, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.execute(ORACLE_SQL["op7_pivot_cells"])
    names, want = [d[0] for d in want.description], want.fetchall()
    got = near_duplicates(df, block=16)
    assert sum(r[names.index("n_links")] for r in want) > 50
    assert by_name(got.columns, got.collect()) == by_name(names, want)
