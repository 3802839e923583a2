"""Every registered query with SQL equals DuckDB's result; queries without are run."""

import glob
import os

import duckdb
import pytest
from comparing import same_rows
from conftest import SF

from glyphmax import catalog


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    same_rows(catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert rows and all(0 <= r["ndcg_5"] <= 1 for r in rows)


def test_ablation(spark):
    rows = {r["variant"]: r for r in catalog.ablation_table(spark, SF).collect()}
    assert rows["baseline"]["compression_ratio"] == 1 and rows["binary"]["compression_ratio"] == 32 and rows["int8"]["compression_ratio"] == 4
    assert rows["baseline"]["tau"] == 1 and rows["full"]["vectors_per_page"] < 10


def test_bootstrap_and_probes(spark):
    r = catalog.bootstrap_ci(spark, SF).first()
    assert r["low"] <= r["high"]
    assert catalog.farthest_probes(spark, SF).count() == 8
