"""Files stored more than once, from recorded digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.operators.skew import join_by_weight
from slimlake.session import cut

# The states a duplicate report looks at; claimed rows are in flux.
COMPARED_STATES = ("pending", "done", "skipped", "failed")


def compared(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("state").isin(*COMPARED_STATES))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("size") != 0) & F.col("blake3").isNotNull())


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest and size held by more than one path.

    Only counters and the least path are kept per group, so partial aggregation
    shrinks even a group that holds most of the rows.
    """
    return (
        _hashed(rows)
        .groupBy("blake3", "size")
        .agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))
        .where(F.col("copies") > 1)
        .withColumn("recoverable", F.col("size") * (F.col("copies") - 1))
    )


def members(rows: DataFrame) -> DataFrame:
    """Every path of every group, one row each rather than one array per group."""
    found = cut(groups(rows))
    data = _hashed(rows).select("blake3", "size", "path")
    return join_by_weight(data, found, ["blake3", "size"], "copies")


def in_report_order(df: DataFrame) -> DataFrame:
    """Largest recoverable first, then by first path, then by path if present."""
    tail = ["path"] if "path" in df.columns else []
    return df.orderBy(F.desc("recoverable"), F.asc("first_path"), *tail)


def totals(rows: DataFrame) -> DataFrame:
    """One row: groups, redundant files, recoverable bytes, and what was not compared."""
    found = groups(rows).agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("redundant_files"),
        F.coalesce(F.sum("recoverable"), F.lit(0)).alias("recoverable"),
    )
    blind = rows.where((F.col("size") != 0) & F.col("blake3").isNull()).agg(
        F.count("*").alias("unhashed")
    )
    return found.withColumn("unhashed", blind.scalar())
