"""Progress lines (``key=value``) folded into one row per finished block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.functions.columns import col
from slimlake.operators.ordered import carry_last


def line_values(lines: DataFrame) -> DataFrame:
    """``(job, seq, line)`` -> what each line sets; a bad value sets nothing."""
    key = F.trim(F.substring_index("line", "=", 1))
    value = F.trim(F.substring("line", F.instr("line", "=") + 1, F.length("line")))
    is_pair = F.col("line").contains("=")
    time_us = value.try_cast("bigint")
    speed = F.regexp_replace(value, r"x+\z", "").try_cast("double")
    return lines.select(
        "job",
        F.col("seq").cast("long").alias("seq"),
        F.when(is_pair & (key == "out_time_us") & (time_us >= 0), time_us).alias("_time"),
        F.when(is_pair & (key == "speed"), speed).alias("_speed"),
        F.coalesce(is_pair & (key == "progress"), F.lit(False)).alias("ends_block"),
    )


def with_running_values(values: DataFrame) -> DataFrame:
    """Each line with the values in force after it; they start at zero."""
    filled = carry_last(values, ["seq"], {"out_time_us": "_time", "speed": "_speed"}, ["job"])
    return filled.select(
        "job",
        "seq",
        F.coalesce("out_time_us", F.lit(0).cast("long")).alias("out_time_us"),
        F.coalesce("speed", F.lit(0.0)).alias("speed"),
        "ends_block",
    )


def finished_blocks(running: DataFrame) -> DataFrame:
    return running.where(col("ends_block")).drop("ends_block")


def progress_blocks(lines: DataFrame) -> DataFrame:
    """Batch form: one row per finished block."""
    return finished_blocks(with_running_values(line_values(lines)))
