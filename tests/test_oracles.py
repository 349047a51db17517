"""The driver's correctness gate inside pytest: every registered query against its DuckDB oracle."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.compare import compare, duck
from trailscope import oracles, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(oracles.oracle_sql()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, name):
    ok, message = compare(spark, name, SF, con)
    assert ok, message
