from __future__ import annotations

import os

import pytest

from tessera.plans import catalogue
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_round_trips(spark):
    assert catalogue.QUERIES["path_round_trip"](spark, DATA).first().changed == 0
    assert all(r.broken == 0 for r in catalogue.QUERIES["bundle_invariants"](spark, DATA).collect())
