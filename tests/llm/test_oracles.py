"""Queries of the subpackage that SQL expresses, against DuckDB."""

import pytest

from loomstead.llm import queries
from tests.oracle import compared, database

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    got, want, columns, names = compared(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], database(FOLDER))
    assert columns == names and got == want


def test_every_operator_is_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in queries.QUERIES}
