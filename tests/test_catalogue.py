"""The library's own queries against their SQL in DuckDB, over whole tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = sql.execute(catalogue.ORACLE_SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "content_hash", "n_obs", "n_src", "score"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
