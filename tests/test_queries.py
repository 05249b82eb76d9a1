"""Every registered query against its SQL, on the smallest data."""

from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__ as driver
from __spark_entry__ import entry
from codecairn.catalog.oracles import oracles
from codecairn.catalog.queries import registered

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(registered()) == set(oracles())
    assert set(registered()) <= set(driver.queries()) and set(oracles()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, name):
    assert difference(spark, con, name, registered()[name], oracles()[name], DATA) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["doc_type", "document", "chunk_ord", "title", "heading", "content", "score"]
    assert df.count() == 10
