"""The driver's contract, and every query against its SQL on the smallest scale."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import QUERIES
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name)
    assert ok, note
