"""Every registered query of the library against its SQL in DuckDB, and the driver's entry points."""

import pytest

from loomstead import queries
from tests.oracle import compared, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got, want, columns, names = compared(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], db)
    assert columns == names
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_needs_the_optional_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "loomstead.llm" not in path.read_text(), path
