"""Limits of imports at their very edges, against the SQL."""

from __future__ import annotations

import duckdb

from lodestone.plans import catalogue
from lodestone.plans.operations import IMPORT_BYTES


def test_every_form_at_the_limit_of_bytes(spark, tmp_path):
    rows = [(4 * i + kind, n) for kind in range(4) for i, n in enumerate(range(IMPORT_BYTES - 13, IMPORT_BYTES + 2))]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.ORACLE_SQL["import_limits"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["import_limits"](spark, str(tmp_path)).collect())) == want
