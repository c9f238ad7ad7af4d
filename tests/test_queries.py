import pytest

from sheetwise import registry

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, DATA).count() > 0
