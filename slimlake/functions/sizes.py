"""Byte counts, gains and progress figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions.columns import col


def clamp_size(size) -> Column:
    """Unknown sizes arrive as -1 and count as zero."""
    return F.greatest(col(size), F.lit(0).cast("long"))


def saturating_sub(a, b) -> Column:
    return F.greatest(col(a) - col(b), F.lit(0).cast("long"))


def saving_fraction(before, after) -> Column:
    """Share saved, never negative; 0 for an empty input."""
    return F.when(col(before) == 0, F.lit(0.0)).otherwise(
        saturating_sub(before, after).cast("double") / col(before).cast("double")
    )


def signed_saving_fraction(before, after) -> Column:
    """Share saved, negative for growth; 0 for an empty input."""
    return F.when(col(before) == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - col(after).cast("double") / col(before).cast("double")
    )


def is_worthwhile(before, after, min_gain: float = K.MIN_GAIN) -> Column:
    """The gain gate: at least ``min_gain`` of a non-empty input saved."""
    return F.when(col(before) == 0, F.lit(False)).otherwise(
        saving_fraction(before, after) >= F.lit(min_gain)
    )


def shrunk(size, ratio) -> Column:
    """Whole bytes expected at ``ratio``, truncated per row."""
    return F.floor(col(size).cast("double") * col(ratio)).cast("long")


def bytes_to_mib(size) -> Column:
    """Whole MiB, rounded up, held at the largest unsigned 32-bit value."""
    whole = F.shiftright(col(size).cast("long") + F.lit(K.MIB - 1), 20)
    return F.least(whole, F.lit(K.MAX_MIB).cast("long"))


def progress_fraction(done_us, total_secs) -> Column:
    """Share done, between 0 and 1; null while the total is unknown."""
    share = col(done_us).cast("double") / F.lit(1e6) / col(total_secs)
    return F.when(col(total_secs) > 0, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def eta_secs(done_us, speed, total_secs) -> Column:
    """Seconds still to go; null without a total or a speed."""
    left = (col(total_secs) - col(done_us).cast("double") / F.lit(1e6)) / col(speed)
    return F.when((col(total_secs) > 0) & (col(speed) > 0), F.greatest(left, F.lit(0.0)))
