"""Every query of the subpackage runs on the smallest tables, and agrees with its SQL where it has one."""

import pytest

from tidemark.llm import queries, sql

from ..conftest import SMALL
from ..test_oracle import agrees, small_tables


#: A hundred texts can't meet shares or fill containers; these are checked on a thousand.
LARGER = {"mix_checks", "packing_checks"}


@pytest.fixture(scope="module")
def db():
    return small_tables()


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - LARGER))
def test_query(spark, db, name):
    agrees(queries.queries()[name](spark, SMALL), db, sql.oracle_sql().get(name))


@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_on_more_texts(spark, name):
    folder = SMALL.replace("0.001", "0.01")
    agrees(queries.queries()[name](spark, folder), small_tables(folder), sql.oracle_sql().get(name))
