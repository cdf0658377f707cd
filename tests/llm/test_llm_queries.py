from __future__ import annotations

import os

import pytest

from tessera.llm.queries import QUERIES, SQL
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_model_on_rows_it_was_not_trained_on():
    """Held-out accuracy against labels by pattern, on another scale's segments."""
    import pyarrow.parquet as pq

    from tessera.llm import pii, pii_labels

    texts = sorted({t for t in pq.read_table(f"{DATA}/segments.parquet", columns=["text"]).column(0).to_pylist() if t})
    names = tuple(sorted({n.lower() for n in pq.read_table(f"{DATA}/given_names.parquet", columns=["given_name"]).column(0).to_pylist() if n}))
    got = {(i, a, k) for i, a, _, k in pii.detect(texts, names)}
    want = {(i, a, k) for i, t in enumerate(texts) for a, _, k in pii_labels.spans(t)}
    assert want and len(got & want) >= 0.95 * max(len(got), len(want))
