import os

import pytest

from strandline.plans import queries as core
from strandline.plans import lifecycle, utilities  # noqa: F401
from tests.compare import connection, rows_of, rows_of_sql
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    columns, got = rows_of(core.queries()[name](spark, SMALL))
    expected_columns, expected = rows_of_sql(con, core.oracle_sql()[name])
    assert columns == expected_columns
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_runs(spark, name):
    assert core.queries()[name](spark, SMALL).count() > 0


def test_name_based_ids(spark):
    import uuid

    for r in core.queries()["name_based_ids"](spark, SMALL).collect():
        assert r["stable_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"queue:{r['job_id']}:{r['position']}"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
