"""Plain selections of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def select(df: DataFrame, columns: str | list[str] = "*", unique: bool = False, where: str | None = None) -> DataFrame:
    """Columns of a table, distinct if ``unique``, of the rows that a SQL predicate holds for."""
    out = df if where is None else df.where(where)
    out = out.select(*([columns] if isinstance(columns, str) else columns))
    return out.distinct() if unique else out
