import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tessella.plans.catalog import CATALOG

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_matches_sql(spark, con, name):
    f, sql = CATALOG[name]
    cols, mine = rows_of(f(spark, DIR))
    wanted_cols, wanted = rows_of_sql(con, sql)
    assert cols == wanted_cols
    assert len(mine) == len(wanted)
    assert mine == wanted


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if not sql])
def test_has_rows(spark, name):
    assert CATALOG[name][0](spark, DIR).count() > 0
