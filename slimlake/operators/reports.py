"""One-level aggregates that commands print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions import sizes
from slimlake.functions.columns import col
from slimlake.functions.text import valid_state
from slimlake.operators.decide import expected_ratio
from slimlake.operators.ledger import is_reclaimable, newer_than


def _zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast("long")


def file_totals() -> list[Column]:
    """Files and bytes, the pair most reports are made of."""
    return [F.count("*").alias("files"), _zero(F.sum("size")).alias("bytes")]


def counts_by_state(ledger: DataFrame) -> DataFrame:
    """One row: a count per state (absent is 0) and all bytes; unknown text fails."""
    checked = ledger.select(valid_state("state").alias("state"), "size")
    return checked.agg(
        *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in K.STATES],
        _zero(F.sum("size")).alias("total_bytes"),
    )


# -- projection --------------------------------------------------------------


def projection(decided: DataFrame) -> DataFrame:
    """Files and bytes per recipe and per reason, in name order."""
    rows = decided.select(
        F.when(F.col("recipe").isNotNull(), "convert").otherwise("skip").alias("outcome"),
        F.coalesce("recipe", "skip_reason").alias("name"),
        "size",
        F.when(
            F.col("recipe").isNotNull(), sizes.shrunk("size", expected_ratio("recipe"))
        ).alias("output"),
    )
    return rows.groupBy("outcome", "name").agg(
        *file_totals(), F.sum("output").alias("output_bytes")
    )


def projection_totals(decided: DataFrame) -> DataFrame:
    """One row over everything that would convert; output truncates per row."""
    converts = F.col("recipe").isNotNull()
    output = sizes.shrunk("size", expected_ratio("recipe"))
    sums = decided.agg(
        F.count(F.when(converts, 1)).alias("files"),
        _zero(F.sum(F.when(converts, F.col("size")))).alias("input_bytes"),
        _zero(F.sum(F.when(converts, output))).alias("output_bytes"),
    )
    return sums.withColumns(
        {
            "saving_bytes": sizes.saturating_sub("input_bytes", "output_bytes"),
            "saving_fraction": sizes.saving_fraction("input_bytes", "output_bytes"),
        }
    )


def deferred(decided: DataFrame) -> DataFrame:
    """What cannot be judged without the bytes."""
    waits = F.coalesce(F.col("skip_reason") == "needs_probe", F.lit(False))
    return decided.agg(
        F.count(F.when(waits, 1)).alias("files"),
        _zero(F.sum(F.when(waits, F.col("size")))).alias("bytes"),
    )


# -- books -------------------------------------------------------------------


def savings(ledger: DataFrame) -> DataFrame:
    done = ledger.where((F.col("state") == "done") & F.col("output_size").isNotNull())
    return done.agg(
        F.count("*").alias("files"),
        _zero(F.sum("size")).alias("original_bytes"),
        _zero(F.sum("output_size")).alias("output_bytes"),
    ).withColumn("logical_bytes", sizes.saturating_sub("original_bytes", "output_bytes"))


def pending_reclaim(ledger: DataFrame) -> DataFrame:
    return ledger.where(is_reclaimable()).agg(*file_totals())


def retention(ledger: DataFrame, days: int, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """Whether everything that waits is old enough; one young row holds all back."""
    rows = ledger.where(is_reclaimable()).withColumn("_young", newer_than(days, as_of))
    out = rows.groupBy(*(by or [])).agg(
        *file_totals(), F.count(F.when(F.col("_young"), 1)).alias("too_recent")
    )
    return out.withColumn("ready", (F.col("files") > 0) & (F.col("too_recent") == 0))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Fold of ``(outcome, input_bytes, output_bytes)``."""
    def count(name: str) -> Column:
        return F.count(F.when(F.col("outcome") == name, 1)).alias(name)

    converted = F.col("outcome") == "converted"
    return outcomes.agg(
        *[count(n) for n in ("converted", "skipped", "failed", "cancelled")],
        _zero(F.sum(F.when(converted, F.col("input_bytes")))).alias("input_bytes"),
        _zero(F.sum(F.when(converted, F.col("output_bytes")))).alias("output_bytes"),
    ).withColumn("saved_bytes", sizes.saturating_sub("input_bytes", "output_bytes"))


def settings_comparison(runs: DataFrame) -> DataFrame:
    """Per setting: signed saving, scores, time, and whether any run lost metadata.

    ``runs`` has one row per sample and setting.
    """
    keys = ["preset", "temporal_filtering", "crf"]
    sums = runs.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("output_bytes").alias("output_bytes"),
        F.avg("mean").alias("mean"),
        F.min("low_percentile").alias("low_percentile"),
        F.sum("elapsed_secs").alias("elapsed_secs"),
        F.min("metadata_kept").alias("metadata_kept"),
    )
    return sums.withColumns(
        {
            "saving_fraction": sizes.signed_saving_fraction("input_bytes", "output_bytes"),
            "warn": ~F.col("metadata_kept"),
        }
    )


def failure_histogram(ledger: DataFrame) -> DataFrame:
    failed = ledger.where(F.col("state") == "failed")
    return failed.groupBy(
        F.substring("skip_reason", 1, K.ERROR_PREFIX_CHARS).alias("error")
    ).agg(F.count("*").alias("files"))


def accounting(ledger: DataFrame, quota: DataFrame) -> DataFrame:
    """Logical saving, bytes still held, and free space: three figures, never one.

    ``quota`` is one row with a ``free`` that may be null. Both ledger figures
    come from one pass.
    """
    held = is_reclaimable()
    counted = (F.col("state") == "done") & F.col("output_size").isNotNull()
    books = ledger.agg(
        _zero(F.sum(F.when(counted, F.col("size")))).alias("_in"),
        _zero(F.sum(F.when(counted, F.col("output_size")))).alias("_out"),
        F.count(F.when(held, 1)).alias("pending_files"),
        _zero(F.sum(F.when(held, F.col("size")))).alias("pending_bytes"),
    )
    return books.select(
        sizes.saturating_sub("_in", "_out").alias("logical_bytes"),
        "pending_files",
        "pending_bytes",
        quota.select("free").scalar().alias("remote_free"),
    )


def reclaim_check(reclaimed, free_before, free_after) -> tuple[Column, Column]:
    """``(gained, short)``: short when under half of what was released came back."""
    gained = sizes.saturating_sub(free_after, free_before)
    short = (col(reclaimed) > 0) & (gained * 2 < col(reclaimed))
    return gained, short


# -- texts -------------------------------------------------------------------


def refusal(path, output_path, recipe, fidelity) -> Column:
    """Why a row cannot be restored; null when it can."""
    recipe = col(recipe)
    keeps_content = recipe.isin("jxl-from-raster", "ffv1", "ts-remux")
    return F.when(
        ~F.coalesce(col(fidelity) == K.BYTE_EXACT, F.lit(False)),
        F.when(recipe == "av1", F.concat(col(path), F.lit(": a lossy re-encode cannot be undone")))
        .when(
            keeps_content,
            F.concat(col(path), F.lit(": content kept in "), col(output_path), F.lit(", original bytes not")),
        )
        .otherwise(
            F.concat(col(path), F.lit(": "), recipe, F.lit(" held only "), col(fidelity), F.lit(" fidelity"))
        ),
    )


def quota_advice(policy: str, pending_bytes) -> Column:
    """Why used space has not dropped, by retention policy; null when nothing waits."""
    texts = {
        "keep": " bytes of originals are held and still count; check results, then clean up",
        "purge_after_days": " bytes of originals are held until the retention period ends",
        "purge_now": " bytes of originals are held and were not purged; clean up",
    }
    return F.when(
        col(pending_bytes) != 0, F.concat(col(pending_bytes).cast("string"), F.lit(texts[policy]))
    )
