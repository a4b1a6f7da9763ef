"""Every registered query and its oracle."""

from slimlake.catalog import (  # noqa: F401
    aggregates, filters, joins, projections, recompression, scalars, sources, streams,
    transitions, windows,
)
from slimlake.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
