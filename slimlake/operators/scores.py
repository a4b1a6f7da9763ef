"""Quality scores: aggregation, gates and the choice of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slimlake import constants as K

#: Scores are summed as whole numbers of this part of a point, as score logs print them.
SCORE_UNITS = 1_000_000

#: Percentiles narrow down to cells of 2**-10 of a point, then 2**-28.
CELL_BITS = (10, 28)


def nearest_rank(count, percent: float) -> Column:
    """1-based rank of a percentile that some row actually has."""
    return F.greatest(F.ceil(F.lit(percent) / 100.0 * count), F.lit(1)).cast("long")


def _cell(score: Column, bits: int) -> Column:
    """Number of the cell of width ``2**-bits`` that holds a score; keeps Spark's order."""
    return F.coalesce(F.floor(score.cast("double") * float(1 << bits)), F.lit(-(1 << 63)))


def _picked(histogram: DataFrame, group: list[str], cell: str) -> DataFrame:
    """The cell of each group that holds the row of rank ``_rank``, and its rank in there."""
    upto = F.sum("_in").over(Window.partitionBy(*group).orderBy(cell))
    before = F.col("_upto") - F.col("_in")
    inside = (F.col("_upto") >= F.col("_rank")) & (before < F.col("_rank"))
    found = histogram.withColumn("_upto", upto).where(inside)
    return found.withColumn("_rank", F.col("_rank") - before).drop("_in", "_upto")


def score_summary(
    scores: DataFrame, item: list[str], percent: float = K.LOW_PERCENTILE, score: str = "score"
) -> DataFrame:
    """Mean, minimum, nearest-rank low percentile and frame count per item.

    The mean is one division of whole numbers, so it does not depend on the order of
    rows. The percentile is exact and nothing is sorted for it: a histogram finds the cell
    that holds the rank, the scores of that cell are counted in finer cells, and so on
    down to the scores themselves. Every step is a partial aggregation, and a window sees
    the cells of one histogram only: 2**10 for each point of the scores' range, then at
    most 2**18, and in the last cell at most 2**24 different scores of 1 or more. Null scores count as frames and stand first;
    null items are an item. A score that is no number, or too large to be summed in
    ``SCORE_UNITS``, is an error.
    """
    # A structure equals another with nulls in the same places, in joins as well.
    keyed = scores.select(F.struct(*item).alias("_item"), F.col(score).alias("_score"))
    counted = keyed.groupBy("_item", "_score").agg(F.count("*").alias("_n")).withColumns(
        {f"_cell{bits}": _cell(F.col("_score"), bits) for bits in CELL_BITS}
    )
    cells = [f"_cell{bits}" for bits in CELL_BITS]
    units = F.round(F.col("_score") * SCORE_UNITS).cast("long")
    whole = Window.partitionBy("_item")
    figures = ["mean", "min", "frames"]
    first = counted.groupBy("_item", cells[0]).agg(
        F.sum("_n").alias("_in"), F.sum(units * F.col("_n")).alias("_units"), F.min("_score").alias("_min")
    )
    frames = F.sum("_in").over(whole)
    known = first.withColumns(
        {
            "mean": F.sum("_units").over(whole) / (frames * SCORE_UNITS),
            "min": F.min("_min").over(whole),
            "frames": frames,
            "_rank": nearest_rank(frames, percent),
        }
    ).drop("_units", "_min")
    picked = _picked(known, ["_item"], cells[0])
    for at, finer in enumerate([*cells[1:], "_score"], start=1):
        keys = ["_item", *cells[:at]]
        inside = counted.join(picked, keys).groupBy(*keys, finer).agg(
            F.sum("_n").alias("_in"), *[F.first(c).alias(c) for c in (*figures, "_rank")]
        )
        picked = _picked(inside, keys, finer)
    low = F.coalesce("_score", "min").alias("low_percentile")
    return picked.select(*[F.col("_item")[c].alias(c) for c in item], "mean", "min", low, "frames")


def passes(min_mean: float = K.MIN_MEAN_SCORE, min_low: float = K.MIN_LOW_SCORE) -> Column:
    return (F.col("mean") >= min_mean) & (F.col("low_percentile") >= min_low)


def first_passing(attempts: DataFrame, item: list[str]) -> DataFrame:
    """Of measured attempts ``(attempt, crf, mean, low_percentile)``, the first that passes.

    An item without one reports the scores of its last attempt.
    """
    tried = attempts.where(F.col("attempt").between(1, K.MAX_ATTEMPTS))
    best = F.struct("attempt", "crf", "mean", "low_percentile")
    at = F.when(passes(), F.col("attempt"))
    picked = tried.groupBy(*item).agg(
        F.min_by(best, at).alias("_won"),
        F.max_by(best, "attempt").alias("_last"),
    )
    use = F.coalesce("_won", "_last")
    return picked.select(
        *item,
        F.col("_won").isNotNull().alias("passed"),
        *[use[c].alias(c) for c in ("attempt", "crf", "mean", "low_percentile")],
    )


def setting_ladder(first_crf) -> Column:
    """The settings of attempts 1..3, each tightened by 2 and ending at zero."""
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(K.MAX_ATTEMPTS - 1)),
        lambda i: F.greatest(F.col(first_crf) - i * K.CRF_STEP, F.lit(0)),
    )
    # A start of zero is tried once; a later zero ends the attempts.
    return F.filter(steps, lambda crf, i: (i == 0) | (crf > 0))
