"""Whole commands over the ledger, each one lazy DataFrame (or a few)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.functions import sizes
from slimlake.operators import (
    checks, claims, decide, duplicates, ledger as books, recompress, reports,
)
from slimlake.operators.decide import Limits
from slimlake.operators.scope import EVERYTHING, Scope
from slimlake.session import cut
from slimlake.sources.snapshots import NothingCommitted, SnapshotTable
from slimlake.schemas import LEDGER


def scan(
    table: SnapshotTable, listing: DataFrame, scope: Scope = EVERYTHING,
    seen_at: Column | None = None, **options,
) -> DataFrame:
    """Fold a listing of ``scope`` into the table; returns counts by state."""
    try:
        old = table.read()
    except NothingCommitted:
        old = table.spark.createDataFrame([], LEDGER)
    table.write(books.reconcile(old, listing, scope, seen_at, **options), "scan")
    return reports.counts_by_state(table.read())


def decided(ledger: DataFrame, limits: Limits, scope: Scope = EVERYTHING) -> DataFrame:
    """Pending rows in scope with what a projection would do with each."""
    rows = ledger.where((F.col("state") == "pending") & scope.allows("path"))
    return decide.with_decision(rows.select("path", "size"), decide.plan_limits(limits))


def plan(ledger: DataFrame, limits: Limits, scope: Scope = EVERYTHING) -> DataFrame:
    """What a run would achieve, from the inventory alone, per recipe and reason."""
    return reports.projection(decided(ledger, limits, scope))


def prepare_run(
    ledger: DataFrame, limits: Limits, scope: Scope, retry_failed: bool = False
) -> DataFrame:
    """The ledger as a run finds it: stale claims returned, settings looked at again."""
    ready = books.recover_claimed(ledger)
    if retry_failed:
        ready = books.retry_failed(ready)
    reasons = [*decide.reopened_by(limits.allow_video, limits.allow_av1), "out_of_scope"]
    return books.exclude_out_of_scope(books.reopen_skipped(ready, reasons), scope)


def admit_run(
    ledger: DataFrame, limits: Limits, budget_mib: int, batch: int, order: str = "savings",
    scope: Scope = EVERYTHING, keep_source: bool = False,
) -> DataFrame:
    """The next batch of a run: final skips, refusals, and what fits the budget."""
    batch_rows = claims.start_run(ledger, batch, order, scope)
    judged = decide.with_decision(
        batch_rows.select("path", "size", "mod_time", "projected_saving"), limits
    )
    goes_on = F.col("recipe").isNotNull() | (F.col("skip_reason") == "needs_probe")
    admitted = claims.admit_within_budget(judged.where(goes_on), budget_mib, order, keep_source)
    skipped = judged.where(~goes_on).withColumn("admission", F.lit("skipped"))
    return admitted.unionByName(skipped, allowMissingColumns=True)


def measured_outcomes(attempts: DataFrame) -> DataFrame:
    """Judge measured results ``(path, size, recipe, output_size)`` by the gain gate."""
    return attempts.withColumn(
        "outcome", F.when(sizes.is_worthwhile("size", "output_size"), "converted").otherwise("skipped")
    ).withColumn("skip_reason", F.when(F.col("outcome") == "skipped", "no_gain"))


def run_outcomes(
    ready: DataFrame, attempts: DataFrame, limits: Limits, budget_mib: int, batch: int,
    order: str = "savings", scope: Scope = EVERYTHING, keep_source: bool = False,
) -> DataFrame:
    """What becomes of the next batch: path, outcome, reason, input and output.

    ``attempts`` has one row per path that was worked on: recipe, output_path,
    output_size, fidelity, blake3, error, interrupted. A row that was refused has its
    reason; one that was admitted and not worked on, or interrupted, is cancelled; one
    that waits for space has no outcome.
    """
    admitted = admit_run(ready, limits, budget_mib, batch, order, scope, keep_source)
    tried = attempts.select(
        "path", F.col("recipe").alias("_recipe"), "output_path", "output_size", "fidelity", "blake3", "error",
        F.coalesce("interrupted", F.lit(False)).alias("interrupted"), F.lit(True).alias("_tried"),
    )
    both = admitted.where("admission <> 'waiting'").join(tried, "path", "left")
    outcome = (
        F.when(F.col("admission") != "admitted", "skipped")
        .when(F.col("_tried").isNull() | F.col("interrupted"), "cancelled")
        .when(F.col("error").isNotNull(), "failed")
        .when(sizes.is_worthwhile("size", "output_size"), "converted")
        .otherwise("skipped")
    )
    reason = (
        F.when(F.col("admission") == "skipped", F.col("skip_reason"))
        .when(F.col("admission") != "admitted", F.col("admission"))
        .when(F.col("outcome") == "failed", F.col("error"))
        .when(F.col("outcome") == "skipped", F.lit("no_gain"))
    )
    return both.withColumn("outcome", outcome).select(
        "path", "outcome", reason.alias("reason"), F.coalesce("recipe", "_recipe").alias("recipe"),
        "output_path", "output_size", "fidelity", "blake3",
        F.col("size").alias("input_bytes"), F.col("output_size").alias("output_bytes"),
    )


def run(
    table: SnapshotTable, attempts: DataFrame, limits: Limits, budget_mib: int, batch: int, as_of: Column,
    order: str = "savings", scope: Scope = EVERYTHING, retry_failed: bool = False,
    keep_source: bool = False, tag: str | None = None,
) -> DataFrame:
    """A whole run: admit, judge what was measured, record it in one version, sum up.

    The outcomes are written once, so what the summary counts is what was recorded. A
    run under a ``tag`` that is already committed records nothing and sums up nothing.
    """
    told = []

    def change(old: DataFrame) -> DataFrame:
        ready = prepare_run(old, limits, scope, retry_failed)
        told[:] = [cut(run_outcomes(ready, attempts, limits, budget_mib, batch, order, scope, keep_source))]
        return books.settle(ready, told[0], as_of)

    table.update(change, "run", tag)
    empty = "outcome string, input_bytes long, output_bytes long"
    return reports.run_summary(told[0] if told else table.spark.createDataFrame([], empty))


def dry_run(ledger: DataFrame, attempts: DataFrame, pure: bool = False) -> DataFrame:
    """The ledger after a dry run: skips are recorded, conversions return to pending.

    ``pure`` leaves the ledger as it was.
    """
    if pure:
        return ledger
    judged = measured_outcomes(attempts)
    updates = judged.select(
        "path",
        F.when(F.col("outcome") == "converted", "pending").otherwise("skipped").alias("state"),
        "skip_reason",
    )
    return books.set_state(ledger, updates)


def report(ledger: DataFrame, quota: DataFrame) -> DataFrame:
    """Counts by state beside the three accounting figures: one row."""
    figures = reports.accounting(ledger, quota).select(F.struct("*").alias("f")).scalar()
    counts = reports.counts_by_state(ledger).withColumn("_figures", figures)
    return counts.select("*", "_figures.*").drop("_figures")


def dedup(ledger: DataFrame, scope: Scope = EVERYTHING) -> DataFrame:
    """Every copy of everything stored more than once, biggest win first."""
    rows = duplicates.compared(ledger).where(scope.allows("path"))
    return duplicates.in_report_order(duplicates.members(rows))


def verify(
    ledger: DataFrame, listing: DataFrame, rebuilt: DataFrame, sample: int | None = None,
    scope: Scope = EVERYTHING,
) -> DataFrame:
    return checks.verify_completed(claims.verify_sample(ledger, sample, scope), listing, rebuilt)


def restorable(ledger: DataFrame, wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """For wanted paths: the recorded conversion and whether it may be restored."""
    found = books.completed_for(ledger, wanted)
    there = listing.select("path", F.lit(True).alias("_exists"))
    why = reports.refusal("path", "output_path", "recipe", "fidelity")
    refused = F.when(F.col("_exists"), F.concat(F.col("path"), F.lit(" already exists"))).otherwise(why)
    return (
        wanted.select(F.col("path").alias("wanted")).distinct()
        .join(found, "wanted", "left")
        .join(there, "path", "left")
        .select(
            "wanted", "path", "output_path",
            F.when(F.col("path").isNull(), F.concat(F.lit("no recorded conversion for "), F.col("wanted")))
            .otherwise(refused)
            .alias("refusal"),
        )
    )


def cleanup(ledger: DataFrame, free_before: int | None, free_after: int | None) -> DataFrame:
    """What emptying the trash released, checked against what came back."""
    gained, short = reports.reclaim_check("bytes", "_before", "_after")
    return (
        reports.pending_reclaim(ledger)
        .withColumns(
            {"_before": F.lit(free_before).cast("long"), "_after": F.lit(free_after).cast("long")}
        )
        .select("files", "bytes", gained.alias("gained"), short.alias("short"))
    )


def purge(
    ledger: DataFrame, days: int, as_of: Column, table: SnapshotTable | None = None,
    versions: list[int] | None = None, execute: bool = False,
) -> DataFrame:
    """The ledger after releasing kept originals, if none of them is too young.

    Without ``execute`` nothing is removed and the ledger is returned as it was;
    ``recompress.purge_plan`` lists what would go. Removing is final.
    """
    state = reports.retention(ledger, days, as_of).first()
    if not (execute and state["ready"]):
        return ledger
    if table is not None and versions:
        table.drop_data(versions)
    return books.mark_reclaimed(ledger)
