"""Running totals and ranks over an order, without one task seeing everything.

A window without partitions, or one partitioned by a key that holds a third of
all rows, would run in a single task. Instead the rows are range-partitioned on
the whole order, which splits hot keys, and each range ("slice") is numbered and
written once. Every slice is summarised to one row per group, the summaries are
accumulated (a group has at most one row per slice there), and each row adds its
slice's carry to its own running figure inside the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slimlake.session import cut, written

SLICE = "_slice"


def _sort(order: list[str]) -> list[Column]:
    """``"name"`` ascends, ``"-name"`` descends."""
    return [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]


def slices(df: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Number the ranges of ``group + order``; written once, so numbers hold still."""
    keys = [*(F.asc(g) for g in group or []), *_sort(order)]
    return cut(df.repartitionByRange(*keys).withColumn(SLICE, F.spark_partition_id()))


def _join_carry(sliced: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    if group:
        return sliced.join(carry, [*group, SLICE])
    # One row per slice: as many rows as the range shuffle had partitions.
    return sliced.join(F.broadcast(carry), SLICE)


def running(
    df: DataFrame,
    order: list[str],
    sums: dict[str, str],
    group: list[str] | None = None,
    totals: dict[str, str] | None = None,
    sliced: bool = False,
) -> DataFrame:
    """Add inclusive running sums along ``order``, per ``group``.

    ``sums`` and ``totals`` map an output name to a whole-number input column;
    totals are of the entire group. ``order`` must be total within a group. With
    ``sliced`` the input already carries slice numbers for this order.
    """
    group, totals = list(group or []), totals or {}
    base = df if sliced else slices(df, order, group)
    wanted = {**sums, **totals}
    summary = base.groupBy(*group, SLICE).agg(
        *[F.sum(source).alias(f"_part_{name}") for name, source in wanted.items()]
    )
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    earlier = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *group,
        SLICE,
        *[
            F.coalesce(F.sum(f"_part_{name}").over(earlier), F.lit(0)).alias(f"_carry_{name}")
            for name in sums
        ],
        *[F.sum(f"_part_{name}").over(whole).alias(name) for name in totals],
    )
    inside = (
        Window.partitionBy(*group, SLICE)
        .orderBy(*_sort(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _join_carry(base, carry, group)
    return joined.select(
        *[c for c in base.columns if c != SLICE],
        *[
            (F.col(f"_carry_{name}") + F.coalesce(F.sum(source).over(inside), F.lit(0))).alias(name)
            for name, source in sums.items()
        ],
        *totals,
    )


def ranked(
    df: DataFrame,
    order: list[str],
    group: list[str] | None = None,
    name: str = "row_no",
    count: str | None = None,
) -> DataFrame:
    """Add the 1-based position along ``order``, and the group's size if asked."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    totals = {count: "_one"} if count else None
    return running(ones, order, {name: "_one"}, group, totals).drop("_one")


def carry_last(
    df: DataFrame, order: list[str], values: dict[str, str], group: list[str] | None = None
) -> DataFrame:
    """Add, per output name, the latest non-null input value up to each row.

    ``order`` ascends here.
    """
    group = list(group or [])
    base = slices(df, order, group)
    at = F.struct(*order)
    summary = base.groupBy(*group, SLICE).agg(
        *[
            F.max_by(source, F.when(F.col(source).isNotNull(), at)).alias(f"_part_{name}")
            for name, source in values.items()
        ]
    )
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *group,
        SLICE,
        *[
            F.last(f"_part_{name}", ignorenulls=True).over(earlier).alias(f"_carry_{name}")
            for name in values
        ],
    )
    inside = (
        Window.partitionBy(*group, SLICE)
        .orderBy(*_sort(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return _join_carry(base, carry, group).select(
        *[c for c in base.columns if c != SLICE],
        *[
            F.coalesce(
                F.last(source, ignorenulls=True).over(inside), F.col(f"_carry_{name}")
            ).alias(name)
            for name, source in values.items()
        ],
    )


def follow(hops: DataFrame, start: int) -> DataFrame:
    """All places that a walk from ``start`` comes to: one row (at), ``start`` included.

    ``hops`` (place, next) has at most one row per place and never goes back. Hops of twice
    the length are joined from those before, so a walk of ``n`` steps takes ``log2(n)`` joins.
    """
    reached = hops.sparkSession.createDataFrame([(start,)], "at long")
    known = 1
    while True:
        # Neither side is bounded, so neither is broadcast.
        further = reached.join(hops.hint("merge"), reached["at"] == hops["place"]).select(F.col("next").alias("at"))
        reached = written(reached.union(further), "walk-reached")
        now = reached.count()
        if now == known:
            return reached
        known = now
        second = hops.select(F.col("place").alias("next"), F.col("next").alias("_then"))
        hops = written(hops.join(second.hint("merge"), "next").select("place", F.col("_then").alias("next")), "walk-hops")
