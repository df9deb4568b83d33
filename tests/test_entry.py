"""Entry points: shape of the contract, and a few queries next to their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check_queries import TABLES, compare


def test_every_oracle_has_a_query():
    names, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 100


def test_entry_runs(spark, sf_dir):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "balance_rank_in_segment" in df.columns


@pytest.mark.parametrize(
    "name", ["clean_customers", "merge_by_pk", "stream_cdc", "graph_edges", "acl_visible", "enrich_budget"]
)
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    line = compare(spark, connection, name, sf_dir)
    assert ": ok" in line, line
