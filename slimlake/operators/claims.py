"""Handing out work: orders, batches, budgets and worker shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.functions import sizes
from slimlake.operators.decide import is_video, kind_of, reservation_mib
from slimlake.operators.ledger import is_completed
from slimlake.operators.ordered import carry_last, follow, ranked, running
from slimlake.operators.scope import EVERYTHING, Scope
from slimlake.session import cut, written

# Every order ends in the path, so it is total and a limit repeats.
ORDERS = {
    "savings": ["-projected_saving", "-size", "path"],
    "size": ["-size", "path"],
    "path": ["path"],
}


def sort_columns(order: str) -> list[Column]:
    return [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in ORDERS[order]]


def in_order(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(*sort_columns(order))


def pending(ledger: DataFrame, scope: Scope = EVERYTHING) -> DataFrame:
    return ledger.where((F.col("state") == "pending") & scope.contains("path"))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of an order, in that order.

    ``n`` is what one run can start, so its rows may meet in one task.
    """
    return in_order(df, order).limit(n)


def claim_batch(
    ledger: DataFrame, n: int, order: str = "savings", scope: Scope = EVERYTHING
) -> DataFrame:
    """The next ``n`` pending rows in scope, as claimed."""
    return first_rows(pending(ledger, scope), order, n).withColumn("state", F.lit("claimed"))


def apply_claims(ledger: DataFrame, claimed: DataFrame) -> DataFrame:
    """The ledger with the claimed rows marked, so no later batch has them."""
    hit = claimed.select("path", F.lit(True).alias("_hit")).distinct()
    return (
        ledger.join(hit, "path", "left")
        .withColumn("state", F.when(F.col("_hit"), "claimed").otherwise(F.col("state")))
        .drop("_hit")
    )


def start_run(ledger: DataFrame, n: int, order: str, scope: Scope) -> DataFrame:
    """The next ``n`` rows to start; excluded rows do not count towards ``n``."""
    rows = pending(ledger, scope).where(~scope.excluded("path"))
    return first_rows(rows, order, n)


def assign_workers(claimed: DataFrame, workers: int, order: str = "savings") -> DataFrame:
    """Deal claimed rows out to workers in turn; every row goes to exactly one."""
    numbered = ranked(claimed, ORDERS[order], name="row_no")
    return numbered.withColumn("worker", F.pmod(F.col("row_no") - 1, F.lit(workers)).cast("int"))


def admit_within_budget(
    files: DataFrame, budget_mib: int, order: str = "savings", keep_source: bool = False
) -> DataFrame:
    """Admit work in order while its reservations fit the staging budget.

    ``files`` has a ``recipe`` (null where only the bytes will tell, which
    reserves for the lossy video recipe). A row that alone exceeds the budget is
    refused for good and takes no space. ``admission`` is ``admitted``,
    ``waiting`` or ``too_large_for_budget``.
    """
    provisional = F.coalesce("recipe", F.lit("av1"))
    need = reservation_mib(provisional, "size", keep_source)
    priced = files.withColumn("reservation_mib", need).withColumn(
        "_fits", F.when(F.col("reservation_mib") <= budget_mib, F.greatest("reservation_mib", F.lit(1))).otherwise(0)
    )
    summed = running(priced, ORDERS[order], {"reserved_mib": "_fits"})
    return summed.withColumn(
        "admission",
        F.when(F.col("reservation_mib") > budget_mib, "too_large_for_budget")
        .when(F.col("reserved_mib") <= budget_mib, "admitted")
        .otherwise("waiting"),
    ).drop("_fits")


def capacity_mib(free_bytes: int, reserve_bytes: int) -> int:
    """What uploads may take: the free space less the reserve, in whole MiB."""
    return max(-(-free_bytes // (1 << 20)) - -(-reserve_bytes // (1 << 20)), 0)


def headroom(
    conversions: DataFrame, free_bytes: int, reserve_bytes: int, order: list[str]
) -> DataFrame:
    """Remote space left after each upload, in whole MiB.

    An upload takes its output's size and holds it; a replaced original gives its
    size back once it is reclaimed. ``headroom_before_mib`` is what an upload found.
    """
    capacity = capacity_mib(free_bytes, reserve_bytes)
    priced = conversions.withColumns(
        {
            "upload_mib": F.greatest(sizes.bytes_to_mib("output_size"), F.lit(1).cast("long")),
            "_back": F.when(F.col("reclaimed") == 1, F.col("size")).otherwise(0),
        }
    )
    summed = running(priced, order, {"_spent": "upload_mib", "_returned": "_back"})
    left = F.lit(capacity) - F.col("_spent") + sizes.bytes_to_mib("_returned")
    back_before = sizes.bytes_to_mib(F.col("_returned") - F.col("_back"))
    before = F.lit(capacity) - (F.col("_spent") - F.col("upload_mib")) + back_before
    return summed.withColumns({"headroom_mib": left, "headroom_before_mib": before}).drop(
        "_spent", "_returned", "_back"
    )


def low_water_points(with_headroom: DataFrame, floor_mib: int) -> DataFrame:
    """Rows at which the headroom falls below the floor, having been above it."""
    return with_headroom.where(
        (F.col("headroom_mib") < floor_mib) & (F.col("headroom_before_mib") >= floor_mib)
    )


def reclaim_when_low(
    conversions: DataFrame, free_bytes: int, reserve_bytes: int, floor_mib: int, order: list[str]
) -> DataFrame:
    """Uploads along ``order``, with a purge before each one that finds too little headroom.

    A purge gives back all originals replaced since the last one, so the rows after it see
    that space; what is given back is rounded up to MiB once, on its running total. An
    upload that still does not fit waits, and so do all rows after it, as nothing will
    free space any more.

    Adds ``admission`` (``uploaded`` or ``waiting``), ``purged`` (a purge came just before),
    ``headroom_mib`` left after the upload, ``returned_bytes`` of all purges so far and
    ``held_bytes``, the originals kept since; the last four are null for waiting rows. A
    null size is 0, an upload takes at least 1 MiB.

    The headroom after a purge depends only on where it falls, and so does the place of
    the next one. All these places are found at once, by meeting the running sum of
    uploads with the sums at which it is too much; then the walk over them is followed. It
    ends at the first row that would not fit even right after a purge: rows from there on
    wait, wherever the last purge was.
    """
    capacity = capacity_mib(free_bytes, reserve_bytes)

    def in_mib(size: Column) -> Column:
        # Running totals may exceed what a single reservation is held at.
        return F.shiftright(size + F.lit((1 << 20) - 1), 20)

    priced = conversions.withColumns(
        {
            "_up": F.greatest(sizes.bytes_to_mib(F.coalesce("output_size", F.lit(0))), F.lit(1).cast("long")),
            "_old": F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")),
            "_one": F.lit(1).cast("long"),
        }
    )
    placed = cut(running(priced, order, {"_spent": "_up", "_replaced": "_old", "_at": "_one"}).drop("_one"))
    found = placed.select(
        F.col("_at").alias("no"),
        (F.col("_spent") - F.col("_up")).alias("spent"),
        (F.col("_replaced") - F.col("_old")).alias("back"),
    )
    # Without negative sizes no purge gives back more than one just before the row.
    most = F.lit(capacity) - F.col("_spent") + in_mib(F.col("_replaced") - F.col("_old"))
    full, least = placed.agg(F.min(F.when(most < 0, F.col("_at"))), F.min("_old")).first()
    if full is not None and least >= 0:
        found = found.where(F.col("no") <= full)
    start = placed.sparkSession.createDataFrame([(0, 0, 0)], "no long, spent long, back long")
    enough = (F.lit(capacity - floor_mib) + in_mib(F.col("back"))).cast("long")
    # Backwards along the sums, the row last seen is the first one that has spent more.
    asked = found.union(start).select((-enough).alias("key"), F.lit(0).alias("kind"), "no", F.lit(None).cast("long").alias("low"))
    given = found.select((-F.col("spent")).alias("key"), F.lit(1).alias("kind"), "no", F.col("no").alias("low"))
    met = carry_last(asked.union(given), ["key", "kind", "no"], {"first_low": "low"})
    hops = met.where("kind = 0 AND first_low IS NOT NULL").select(
        F.col("no").alias("place"), F.greatest("first_low", F.col("no") + 1).alias("next")
    )
    purges = follow(written(hops, "purge-hops"), 0).select(F.col("at").alias("_at"), F.lit(True).alias("_purged"))
    marked = placed.join(purges, "_at", "left").withColumn(
        "_back", F.when(F.col("_purged"), F.col("_replaced") - F.col("_old"))
    )
    returned = F.coalesce("_returned", F.lit(0))
    walked = cut(
        carry_last(marked, ["_at"], {"_returned": "_back"}).withColumns(
            {
                "purged": F.coalesce("_purged", F.lit(False)),
                "headroom_mib": F.lit(capacity) - F.col("_spent") + in_mib(returned),
                "returned_bytes": returned,
                "held_bytes": F.col("_replaced") - returned,
            }
        )
    )
    stop = walked.where("headroom_mib < 0").agg(F.min("_at")).scalar()
    waits = F.coalesce(F.col("_at") >= stop, F.lit(False))
    figures = ("purged", "headroom_mib", "returned_bytes", "held_bytes")
    return walked.select(
        *[F.col(f"`{c}`") for c in conversions.columns],
        F.when(waits, "waiting").otherwise("uploaded").alias("admission"),
        *[F.when(~waits, F.col(c)).alias(c) for c in figures],
    )


# -- samples -----------------------------------------------------------------


def largest_completed(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    done = ledger.where(is_completed())
    return in_order(done, "size") if limit is None else first_rows(done, "size", limit)


def bench_sample(ledger: DataFrame, n: int, scope: Scope = EVERYTHING) -> DataFrame:
    """The ``n`` largest pending videos in scope."""
    videos = ledger.where(
        (F.col("state") == "pending") & scope.allows("path") & is_video(kind_of("path"))
    )
    return first_rows(videos, "size", n)


def verify_sample(ledger: DataFrame, n: int | None, scope: Scope = EVERYTHING) -> DataFrame:
    """Completed rows in scope, the first ``n`` by size; all of them need no order."""
    done = ledger.where(is_completed() & scope.allows("path"))
    return done if n is None else first_rows(done, "size", n)
