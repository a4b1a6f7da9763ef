"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def join_by_weight(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key.

    ``weight`` in ``keyed`` is how many rows a key has in ``rows``. Keys with more
    than 1/1000 of all those rows number fewer than 1000, so they are broadcast;
    the rest are joined by shuffle, where no key is large.
    """
    limit = keyed.agg(F.sum(weight) / HOT_SHARE).scalar()
    hot = keyed.where(F.col(weight) > limit)
    cold = keyed.where(F.col(weight) <= limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))

