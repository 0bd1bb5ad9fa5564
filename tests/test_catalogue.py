"""Every query equals its SQL on the smallest tables; the entry runs."""

import pytest

import __spark_entry__ as entry_module
from lexora.plans import catalogue
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same(catalogue.queries()[name](spark, sf_dir), duck, catalogue.oracle_sql()[name])


def test_every_query_has_a_callable():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(catalogue.queries()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["entity", "locale", "norm", "parents", "pages", "weight", "spelling"]
    assert df.count() >= 0
