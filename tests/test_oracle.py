"""Every core query beside its SQL on the smallest data set; skipped where the data isn't there."""

import os

import pytest

from tests.oracle import compare, duck
from weftline.plans import catalogue

FOLDER = os.environ.get("WEFTLINE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    said = compare(spark, con, FOLDER, name, catalogue.queries()[name], catalogue.oracle_sql().get(name))
    assert said.startswith("ran" if name in catalogue.NO_SQL else "ok"), said


def test_only_listed_queries_have_no_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == set(catalogue.NO_SQL)
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
