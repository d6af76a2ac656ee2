"""The registry as a whole, and a few queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verify_queries import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries)
    assert len(queries) > 150
    for text in checks.values():
        assert "v_" not in text or text.startswith("WITH ")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["safe_div", "pct_rank_sliced", "sod_features", "token_overlap_match", "run_risk_index",
                                  "link_extract", "top_holder"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    _, text, ok = compare(spark, con, SF, name, entry.oracle_sql()[name])
    assert ok, text
