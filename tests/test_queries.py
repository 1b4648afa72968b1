"""Every query with SQL gives DuckDB's answer; the others run and keep their columns."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SMALL = os.environ.get("SKEIN_TEST_SF", "/root/testdata/sf0.001")
CORE = {n: f for n, f in entry.queries().items() if f.__module__.startswith("skein.plans")}
SLOW = {"oof_confidence", "intent_classifier", "kmeans_sweep", "svd_reduce"}


@pytest.mark.parametrize("name", sorted(n for n in CORE if n in entry.oracle_sql()))
def test_equals_sql(spark, name):
    compare(spark, CORE[name], entry.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(n for n in CORE if n not in entry.oracle_sql() and n not in SLOW))
def test_runs(spark, name):
    df = CORE[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
