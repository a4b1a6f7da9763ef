"""Small helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(value) -> Column:
    """A column from its name, or the column itself."""
    return value if isinstance(value, Column) else F.col(value)


def lookup(key, table: dict) -> Column:
    """Value of ``key`` in a small literal table, null when absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.create_map(*pairs)[col(key)]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    Catalyst copies a projected expression into every filter above it, and an
    expression used many times there is evaluated as often. Filters on the output
    of a generator stay above it; filters on other columns still go below.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))
