import pytest
from compare import DATA, check, connect

from loomwright.plans import catalog

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    assert (check(df, duck, sql) if sql else df.count()) >= 0
