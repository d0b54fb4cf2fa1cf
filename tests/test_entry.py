import importlib
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
REFERENCE = importlib.import_module("newsloom.plans.queries")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i].replace(tzinfo=None) if hasattr(r[i], "tzinfo") else r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["validate_summary_by_source", "rule_errors", "language_detect", "canonical_url", "shingle_counts", "registry_stats"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(REFERENCE.SQL[name])
    columns = [c[0] for c in want.description]
    got = REFERENCE.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
