"""The state table: reconciliation, keyed updates, transitions and lookups.

Every function maps a ledger DataFrame to a new one; ``path`` is its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions.columns import col
from slimlake.functions.text import valid_state
from slimlake.operators.decide import reasons_table, reopened_by, with_projected_saving
from slimlake.operators.scope import EVERYTHING, Scope
from slimlake.schemas import LEDGER, evolve

# -- reconciliation ----------------------------------------------------------


def latest_per_path(listing: DataFrame) -> DataFrame:
    """One row per path; of repeats, the largest by mod_time, size and digest."""
    rank = [c for c in ("mod_time", "size", "blake3") if c in listing.columns]
    return (
        listing.groupBy("path")
        .agg(F.max(F.struct(*rank)).alias("_row"))
        .select("path", *[F.col(f"_row.{c}").alias(c) for c in rank])
    )


def reconcile(
    ledger: DataFrame,
    listing: DataFrame,
    scope: Scope = EVERYTHING,
    seen_at: Column | None = None,
    compare_hash: bool = False,
    keep_known_hash: bool = False,
    sweep: bool = True,
) -> DataFrame:
    """Fold a complete listing of ``scope`` into the ledger.

    New paths become ``pending``. Known ones refresh their metadata and keep
    their state, unless their size changed, which sends them back to ``pending``.
    Rows in scope that are not listed and not ``done`` are dropped. A ``done``
    row that was rewritten in place is compared with the size it was given.

    Only rows in scope are joined; the rest of the ledger passes by without a
    shuffle. A listing row outside ``scope`` is therefore an error. A repeated path
    counts once (``latest_per_path``), in the shuffle that the join needs anyway.
    """
    seen_at = F.lit(None).cast("timestamp") if seen_at is None else seen_at
    if scope.prefixes:
        stray = F.raise_error(F.concat(F.lit("listed outside the scope: "), F.col("path")))
        in_scope = F.when(scope.contains("path"), F.col("path")).otherwise(stray.cast("string"))
        listing = listing.withColumn("path", in_scope)
    fresh = latest_per_path(listing)
    for name in ("mod_time", "blake3"):
        if name not in fresh.columns:
            fresh = fresh.withColumn(name, F.lit(None).cast("string"))
    fresh = with_projected_saving(fresh.select("path", "size", "mod_time", "blake3"))
    whole = evolve(ledger).select(*LEDGER.names)
    inside = whole
    if scope.prefixes:
        inside = whole.where(scope.contains("path"))
    old, new = inside.alias("o"), fresh.withColumn("_listed", F.lit(True)).alias("n")
    both = old.join(new, F.col("o.path") == F.col("n.path"), "full_outer")

    listed = F.col("n._listed").isNotNull()
    known = F.col("o.path").isNotNull()
    in_place = F.coalesce(
        (F.col("o.state") == "done") & (F.col("o.output_path") == F.col("o.path")), F.lit(False)
    )
    held_size = F.when(in_place, F.coalesce("o.output_size", "o.size")).otherwise(F.col("o.size"))
    changed = F.coalesce(held_size != F.col("n.size"), F.lit(False))
    if compare_hash:
        changed = changed | F.coalesce(F.col("o.blake3") != F.col("n.blake3"), F.lit(False))
    reset = listed & (~known | changed)
    keeps_original = listed & known & in_place & ~changed

    def pick(name: str) -> Column:
        """The listed value where listed, except for an in-place result."""
        return F.when(listed & ~keeps_original, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))

    digest = pick("blake3")
    if keep_known_hash:
        digest = F.coalesce(digest, F.when(~reset, F.col("o.blake3")))
    replaced = {
        "path": F.coalesce("n.path", "o.path"),
        "size": pick("size"),
        "mod_time": pick("mod_time"),
        "blake3": digest,
        "state": F.when(reset, "pending").otherwise(F.col("o.state")),
        "skip_reason": F.when(~reset, F.col("o.skip_reason")),
        "seen_at": F.when(listed, F.coalesce(seen_at, F.col("o.seen_at"))).otherwise(F.col("o.seen_at")),
        "reclaimed": F.coalesce("o.reclaimed", F.lit(0)),
        "projected_saving": pick("projected_saving"),
    }
    merged = both.select(
        *[
            replaced.get(f.name, F.col(f"o.{f.name}")).cast(f.dataType).alias(f.name)
            for f in LEDGER.fields
        ],
        listed.alias("_listed"),
    )
    if sweep:
        merged = merged.where(F.col("_listed") | (F.col("state") == "done"))
    merged = merged.drop("_listed")
    if scope.prefixes:
        merged = merged.unionByName(whole.where(~scope.contains("path")))
    return merged


def stale_rows(ledger: DataFrame, listing: DataFrame, scope: Scope = EVERYTHING) -> DataFrame:
    """Rows a complete listing of ``scope`` no longer mentions; ``done`` is exempt."""
    candidates = ledger.where(scope.contains("path") & (F.col("state") != "done"))
    return candidates.join(listing.select("path"), "path", "left_anti")


def sync_counts(ledger: DataFrame, listing: DataFrame, scope: Scope = EVERYTHING) -> DataFrame:
    """How many rows a listing holds and how many it removes."""
    seen = listing.agg(F.count("*").alias("seen"))
    removed = stale_rows(ledger, listing, scope).agg(F.count("*").alias("removed"))
    return seen.withColumn("removed", removed.scalar())


# -- keyed updates -----------------------------------------------------------


def unknown_updates(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates for paths the ledger does not hold."""
    return updates.select("path").join(ledger.select("path"), "path", "left_anti")


def _all_known(ledger: DataFrame, updates: DataFrame, paths: DataFrame) -> DataFrame:
    """The updates, one per path, failing on one of ``paths`` that the ledger lacks.

    The ledger is always the left side here and in the update itself, so that a
    small set of updates can be broadcast and the ledger stays where it is.
    """
    known = ledger.select("path").join(paths, "path", "left_semi")
    marked = updates.join(known.withColumn("_known", F.lit(True)), "path", "left")
    refused = F.raise_error(F.concat(F.lit("no ledger row for "), F.col("path"))).cast("string")
    checked = F.when(F.col("_known").isNotNull(), F.col("path")).otherwise(refused)
    return marked.withColumn("path", checked).drop("_known")


def update_by_path(
    ledger: DataFrame, updates: DataFrame, columns: list[str], unknown: str = "error"
) -> DataFrame:
    """Set ``columns`` from ``updates``, nulls included.

    Repeated updates of a path count once; differing ones are an error.
    ``unknown="error"`` fails on a path the ledger lacks; ``"ignore"`` drops it.
    """
    new = F.struct(*columns)
    once = updates.groupBy("path").agg(F.min(new).alias("_new"), F.max(new).alias("_max"))
    differ = F.raise_error(F.concat(F.lit("differing updates for "), F.col("path"))).cast("string")
    fresh = once.select(
        F.when(F.col("_new").eqNullSafe(F.col("_max")), F.col("path")).otherwise(differ).alias("path"),
        *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in columns],
        F.lit(True).alias("_hit"),
    )
    if unknown == "error":
        fresh = _all_known(ledger, fresh, updates.select("path"))
    joined = ledger.join(fresh, "path", "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).cast(ledger.schema[c].dataType).alias(c)
            if c in columns
            else F.col(c)
            for c in ledger.columns
        ]
    )


def set_state(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``(path, state, skip_reason)``."""
    checked = updates.withColumn("state", valid_state("state"))
    return update_by_path(ledger, checked, ["state", "skip_reason"])


def record_skip(ledger: DataFrame, skips: DataFrame) -> DataFrame:
    """Apply ``(path, skip_reason)`` as skipped."""
    return set_state(ledger, skips.select("path", F.lit("skipped").alias("state"), "skip_reason"))


def record_conversion(ledger: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Apply ``(path, output_path, output_size, recipe, fidelity, blake3)`` as done.

    The digest is the one taken from the bytes that were converted.
    """
    updates = results.select(
        "path", "output_path", "output_size", "recipe", "fidelity", "blake3",
        F.lit("done").alias("state"),
        F.lit(None).cast("string").alias("skip_reason"),
        as_of.alias("trashed_at"),
        F.lit(0).alias("reclaimed"),
    )
    return update_by_path(ledger, updates, [c for c in updates.columns if c != "path"])


def record_hints(ledger: DataFrame, hints: DataFrame) -> DataFrame:
    """Apply ``(path, crf_hint, crf_hint_preset)``; a hint for a gone row is lost."""
    return update_by_path(ledger, hints, ["crf_hint", "crf_hint_preset"], unknown="ignore")


def record_outcomes(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply ``(path, error, interrupted)``: an interruption is not a failure."""
    updates = outcomes.select(
        "path",
        F.when(F.col("interrupted"), "pending").otherwise("failed").alias("state"),
        F.when(~F.col("interrupted"), F.col("error")).alias("skip_reason"),
    )
    return set_state(ledger, updates)


def settle(ledger: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Apply everything a run found out, in one keyed update.

    ``outcomes`` has path, outcome (``converted``, ``skipped``, ``failed`` or
    ``cancelled``), reason, and for converted rows output_path, output_size, recipe,
    fidelity and blake3. A cancelled row is pending again. Other rows stay as they are.
    """
    found = F.struct("outcome", "reason", "output_path", "output_size", "recipe", "fidelity", "blake3")
    updates = outcomes.select("path", found.alias("_found"))
    marked = ledger.withColumn("_found", F.lit(None).cast(updates.schema["_found"].dataType))
    marked = update_by_path(marked, updates, ["_found"])
    outcome = F.col("_found.outcome")
    done = outcome == "converted"

    def converted(name: str, value: Column) -> Column:
        return F.when(done, value).otherwise(F.col(name)).cast(ledger.schema[name].dataType)

    kept = ["output_path", "output_size", "recipe", "fidelity", "blake3"]
    return marked.withColumns(
        {
            "state": F.when(outcome.isNull(), F.col("state"))
            .when(done, "done").when(outcome == "cancelled", "pending").otherwise(outcome),
            "skip_reason": F.when(outcome.isNull(), F.col("skip_reason")).otherwise(F.col("_found.reason")),
            **{name: converted(name, F.col(f"_found.{name}")) for name in kept},
            "trashed_at": converted("trashed_at", as_of),
            "reclaimed": converted("reclaimed", F.lit(0)),
        }
    ).drop("_found")


# -- whole-table transitions -------------------------------------------------


def _move(ledger: DataFrame, when: Column, state: str, reason: Column | None) -> DataFrame:
    new = {"state": F.when(when, F.lit(state)).otherwise(F.col("state"))}
    if reason is not None:
        new["skip_reason"] = F.when(when, reason).otherwise(F.col("skip_reason"))
    return ledger.withColumns(new)


def recover_claimed(ledger: DataFrame) -> DataFrame:
    return _move(ledger, F.col("state") == "claimed", "pending", None)


def retry_failed(ledger: DataFrame) -> DataFrame:
    return _move(ledger, F.col("state") == "failed", "pending", F.lit(None).cast("string"))


def skipped_for(reasons: list[str]) -> Column:
    """Skipped rows with one of ``reasons``; an empty list matches nothing."""
    if not reasons:
        return F.lit(False)
    return (F.col("state") == "skipped") & F.coalesce(F.col("skip_reason").isin(reasons), F.lit(False))


def awaiting_settings(ledger: DataFrame, allow_video: bool, allow_av1: bool) -> DataFrame:
    """Skipped rows that a run with these settings would look at again.

    The reasons are a fixed table of 15 rows, hence the broadcast: each reason may
    hold a large share of the ledger.
    """
    table = reasons_table(ledger.sparkSession)
    wanted = table.where(
        F.col("depends_on_settings") & F.col("skip_reason").isin(reopened_by(allow_video, allow_av1))
    )
    skipped = ledger.where(F.col("state") == "skipped")
    return skipped.join(F.broadcast(wanted), "skip_reason", "left_semi")


def reopen_skipped(ledger: DataFrame, reasons: list[str]) -> DataFrame:
    return _move(ledger, skipped_for(reasons), "pending", F.lit(None).cast("string"))


def exclude_out_of_scope(ledger: DataFrame, scope: Scope) -> DataFrame:
    """Pending rows in the prefixes that an exclude pattern keeps out are skipped."""
    out = (F.col("state") == "pending") & scope.contains("path") & scope.excluded("path")
    return _move(ledger, out, "skipped", F.lit(K.OUT_OF_SCOPE))


def is_reclaimable() -> Column:
    return (F.col("state") == "done") & F.col("trashed_at").isNotNull() & (F.col("reclaimed") == 0)


def mark_reclaimed(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("reclaimed", F.when(is_reclaimable(), 1).otherwise(F.col("reclaimed")).cast("int"))


def latest_state(transitions: DataFrame, seq: str = "seq") -> DataFrame:
    """Fold a transition log to the newest state of each path."""
    return transitions.groupBy("path").agg(
        F.max_by("state", seq).alias("state"), F.max(seq).alias(seq)
    )


# -- lookups -----------------------------------------------------------------


def is_completed() -> Column:
    return (F.col("state") == "done") & F.col("output_path").isNotNull()


def is_restorable() -> Column:
    """Keyed on the guarantee that held, whatever the recipe."""
    return F.col("fidelity") == K.BYTE_EXACT


def newer_than(days: int, as_of) -> Column:
    return F.col("trashed_at") > col(as_of) - F.make_dt_interval(F.lit(days))


def completed_for(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """Completed rows by original or by output path, for a set of paths.

    Each row stands beside both of its paths, so one equality join serves; a join on
    an OR would compare every pair of rows.
    """
    both = F.array_distinct(F.array_compact(F.array("path", "output_path")))
    done = ledger.where(is_completed()).withColumn("wanted", F.explode(both))
    return done.join(wanted.select(F.col("path").alias("wanted")).distinct(), "wanted")


def tuned_settings(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The stored setting of each ``(path, preset)``, only at the preset it holds for."""
    stored = ledger.where(F.col("crf_hint").isNotNull()).select(
        "path", F.col("crf_hint_preset").alias("preset"), "crf_hint"
    )
    return files.join(stored, ["path", "preset"], "left")
