"""Every query with SQL gives DuckDB's rows, and every other one gives rows, on the smallest tables."""

import oracle
import pytest

from spanforge.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, sf, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf), con, registry.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns
    df.collect()
