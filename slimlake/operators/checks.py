"""Comparing what is there with what was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions.columns import col
from slimlake.operators.ledger import is_completed, is_restorable


def verify_completed(ledger: DataFrame, listing: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Check completed rows against the current listing.

    ``listing`` is ``(path, size)``; ``rebuilt`` is ``(path, rebuilt_hash,
    rebuilt_size)``, what undoing the byte-exact ones gave. ``status`` is
    ``rebuilt``, ``present`` or ``failed``, and ``problem`` names a failure.
    """
    done = ledger.where(is_completed()).select(
        "path", "output_path", "size", "output_size", "blake3", "recipe", "fidelity"
    )
    now = listing.select(F.col("path").alias("output_path"), F.col("size").alias("found_size"))
    rows = done.join(now, "output_path", "left").join(
        rebuilt.select("path", "rebuilt_hash", "rebuilt_size"), "path", "left"
    )
    problem = (
        F.when(F.col("found_size").isNull(), "missing")
        .when(F.col("found_size") != F.col("output_size"), "size_differs")
        .when(~is_restorable(), None)
        .when(F.col("blake3").isNull(), "no_recorded_hash")
        .when(F.col("rebuilt_hash").isNull(), "not_rebuilt")
        .when(F.col("rebuilt_hash") != F.col("blake3"), "hash_differs")
        .when(F.col("rebuilt_size") != F.col("size"), "rebuilt_size_differs")
    )
    status = (
        F.when(F.col("problem").isNotNull(), "failed")
        .when(is_restorable(), "rebuilt")
        .otherwise("present")
    )
    return (
        rows.withColumn("problem", problem)
        .withColumn("status", status)
        .select("path", "output_path", "fidelity", "status", "problem")
    )


def verify_summary(checked: DataFrame) -> DataFrame:
    def count(name: str) -> Column:
        return F.count(F.when(F.col("status") == name, 1))

    return checked.agg(
        count("rebuilt").alias("proven"),
        count("present").alias("present"),
        count("failed").alias("failed"),
    )


def require_no_failures(summary: DataFrame) -> None:
    failed = summary.first()["failed"]
    if failed:
        raise RuntimeError(f"{failed} conversion(s) did not verify")


def destination_conflicts(planned: DataFrame, listing: DataFrame) -> DataFrame:
    """Mark planned ``(path, output_path)`` rows whose destination already exists.

    An in-place result replaces its own source and is never a conflict. One join
    marks both kinds, so the plan behind ``planned`` runs once.
    """
    taken = listing.select(F.col("path").alias("output_path")).distinct()
    marked = planned.join(taken.withColumn("_taken", F.lit(True)), "output_path", "left")
    conflict = F.col("_taken").isNotNull() & (F.col("path") != F.col("output_path"))
    return marked.withColumn("conflict", conflict).drop("_taken")


def confirm_written(intended: DataFrame, found: DataFrame) -> DataFrame:
    """Compare written objects with what was meant: ``(path, size, hash)`` both.

    ``outcome``: ``missing``, ``size_mismatch``, ``hash_mismatch``, ``ok``, or
    ``ok_size_only`` where the store reports no hash.
    """
    there = found.select(
        "path", F.col("size").alias("found_size"), F.col("hash").alias("found_hash")
    ).withColumn("_found", F.lit(True))
    outcome = (
        F.when(F.col("_found").isNull(), "missing")
        .when(~F.col("found_size").eqNullSafe(F.col("size")), "size_mismatch")
        .when(F.col("found_hash").isNull(), "ok_size_only")
        .when(F.lower("found_hash") == F.lower("hash"), "ok")
        .otherwise("hash_mismatch")
    )
    joined = intended.join(there, "path", "left")
    return joined.withColumn("outcome", outcome).select("path", "outcome")


def match_salvaged(claimed: DataFrame, salvaged: DataFrame) -> DataFrame:
    """Mark earlier partial work as ``reusable`` if it is of the same file still."""
    now = claimed.select(
        "path", F.col("size").alias("_size"), F.col("mod_time").alias("_time"), F.lit(True).alias("_now")
    )
    same = F.col("_now") & (F.col("size") == F.col("_size")) & F.col("mod_time").eqNullSafe(F.col("_time"))
    return (
        salvaged.join(now, "path", "left")
        .withColumn("reusable", F.coalesce(same, F.lit(False)))
        .drop("_size", "_time", "_now")
    )


def parity(left: DataFrame, right: DataFrame, with_hash: bool = True) -> DataFrame:
    """Differences of two listings of the same place; empty when they agree."""
    names = ["size", "mod_time", *(["blake3"] if with_hash else [])]
    a = left.select("path", *names).withColumn("_in", F.lit(True)).alias("a")
    b = right.select("path", *names).withColumn("_in", F.lit(True)).alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    difference = F.when(F.col("b._in").isNull(), "only_left").when(
        F.col("a._in").isNull(), "only_right"
    )
    for name in names:
        differs = ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
        difference = difference.when(differs, f"{name}_differs")
    return both.select(
        F.coalesce("a.path", "b.path").alias("path"), difference.alias("difference")
    ).where(F.col("difference").isNotNull())


def shape_survived(before: DataFrame, after: DataFrame, item: str) -> DataFrame:
    """Whether width, height and audio codecs are what they were, per item."""
    def shape(df: DataFrame, side: str) -> DataFrame:
        video = F.try_element_at(F.col("probe.video"), F.lit(1))
        return df.select(
            item,
            video["width"].alias(f"{side}_width"),
            video["height"].alias(f"{side}_height"),
            F.col("probe.audio_codecs").alias(f"{side}_audio"),
        )

    both = shape(before, "a").join(shape(after, "b"), item)
    kept = (
        (F.col("a_width") == F.col("b_width"))
        & (F.col("a_height") == F.col("b_height"))
        & (F.col("a_audio") == F.col("b_audio"))
    )
    return both.select(item, F.coalesce(kept, F.lit(False)).alias("metadata_kept"))


def compare_remux(before: DataFrame, after: DataFrame, item: list[str]) -> DataFrame:
    """First difference of two stream digests ``(frames, video, audio)``, per item."""
    b = after.select(*item, *[F.col(c).alias(f"_{c}") for c in ("frames", "video", "audio")])
    difference = (
        F.when(~F.col("frames").eqNullSafe(F.col("_frames")), "frames_dropped")
        .when(~F.col("video").eqNullSafe(F.col("_video")), "video_changed")
        .when(~F.col("audio").eqNullSafe(F.col("_audio")), "audio_changed")
        .otherwise(F.lit(K.CONTENT_EXACT))
    )
    return before.join(b, item, "left").select(*item, difference.alias("outcome"))


def in_place_target(path, output_path, job) -> Column:
    """Where a result is written first: under a marked name when it replaces its source."""
    path, output = col(path), col(output_path)
    return F.when(path == output, F.concat(path, F.lit("."), col(job), F.lit(".part"))).otherwise(output)
