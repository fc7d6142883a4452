import os

import pytest

from strandline.llm import queries as llm
from tests.compare import connection, rows_of, rows_of_sql
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    columns, got = rows_of(llm.queries()[name](spark, SMALL))
    expected_columns, expected = rows_of_sql(con, llm.oracle_sql()[name])
    assert columns == expected_columns
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_runs(spark, name):
    assert llm.queries()[name](spark, SMALL).count() > 0
