"""The registered queries against their DuckDB twins on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations"
NAMES = ["normalize_names", "candidates_topk", "tfidf_name_topk", "addr_pool_capped", "fuse_quota", "rule_score", "threshold_sweep", "average_precision"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = contract.queries()[name](spark, DATA).toPandas(), con.sql(contract.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
