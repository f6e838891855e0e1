import pytest

from lexforge.llm import queries
from tests.llm.helpers import duck, same


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    assert same(queries.queries()[name](spark, sf), duck(sf).sql(queries.oracle_sql()[name]))
