"""Every core query against its SQL on the smallest tables."""

import os

import pytest
from compare import check, connect

from lexweave.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sql, name):
    check(registry.QUERIES[name](spark, FOLDER), sql, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) <= len(rows)
