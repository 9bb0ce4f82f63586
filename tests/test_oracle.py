"""Every registered query of the library's own against its SQL, on the whole small tables."""

import pytest

from __spark_entry__ import entry
from tests.compare import connect, differences
from tickforge.plans import oracle, queries as registered

NAMES = sorted(registered.queries())


@pytest.fixture(scope="module")
def duck(request):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert differences(registered.queries()[name](spark, sf_dir), duck, oracle.oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert sorted(oracle.oracle_sql()) == NAMES


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0
