"""Tool output as columns: probe JSON, score logs, frame-hash dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slimlake.functions.columns import col, once
from slimlake.schemas import RAW_PROBE, RAW_SCORES


def _unsigned(text: Column) -> Column:
    number = text.try_cast("bigint")
    return F.when(number >= 0, number)


def _stream_struct(stream: Column) -> Column:
    side_data = F.coalesce(stream["side_data_list"], F.array())
    return F.struct(
        F.coalesce(stream["codec_name"], F.lit("")).alias("codec"),
        F.coalesce(stream["width"], F.lit(0)).alias("width"),
        F.coalesce(stream["height"], F.lit(0)).alias("height"),
        stream["color_transfer"].alias("color_transfer"),
        _unsigned(stream["bit_rate"]).alias("bit_rate"),
        F.coalesce(
            F.exists(side_data, lambda d: F.lower(d["side_data_type"]).contains("dovi")),
            F.lit(False),
        ).alias("has_dolby_vision"),
    )


def probe_struct(raw) -> Column:
    """Typed probe from the raw JSON struct; null stays null."""
    raw = col(raw)
    streams = F.coalesce(raw["streams"], F.array())

    def of_type(name: str) -> Column:
        return F.filter(streams, lambda s: s["codec_type"] == name)

    names = F.split(F.coalesce(raw["format"]["format_name"], F.lit("")), ",")
    return F.when(
        raw.isNotNull(),
        F.struct(
            F.filter(names, lambda n: n != "").alias("format_names"),
            raw["format"]["duration"].try_cast("double").alias("duration_secs"),
            _unsigned(raw["format"]["bit_rate"]).alias("bit_rate"),
            F.transform(of_type("video"), _stream_struct).alias("video"),
            F.transform(
                of_type("audio"), lambda s: F.coalesce(s["codec_name"], F.lit(""))
            ).alias("audio_codecs"),
            F.size(of_type("subtitle")).alias("subtitle_count"),
        ),
    )


def with_probe(df: DataFrame, json_col: str = "probe", out: str = "probe", strict: bool = True) -> DataFrame:
    """Parse probe JSON into ``out``; ``strict`` makes bad JSON an error, else null."""
    if strict:
        raw = F.from_json(F.col(json_col), RAW_PROBE, {"mode": "FAILFAST"})
    else:
        schema = T.StructType([*RAW_PROBE.fields, T.StructField("_bad", T.StringType())])
        raw = F.from_json(F.col(json_col), schema, {"columnNameOfCorruptRecord": "_bad"})
    parsed = once(df, "_raw_probe", raw)
    probe = probe_struct("_raw_probe")
    if not strict:
        probe = F.when(F.col("_raw_probe._bad").isNull(), probe)
    return once(parsed, out, probe).drop("_raw_probe")


def is_finite(score) -> Column:
    score = col(score)
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


NO_SCORES = "no usable scores"


def scores_from_log(df: DataFrame, json_col: str, keys: list[str], strict: bool = True) -> DataFrame:
    """Score-log JSON -> one row per frame with a usable score.

    An item without any is an error; with ``strict`` off it is one row without frame
    and score, and ``problem`` says why. So no item passes a gate by being absent.
    """
    log = F.from_json(F.col(json_col), RAW_SCORES, {"mode": "FAILFAST"})
    usable = F.filter(
        F.coalesce(log["frames"], F.array()), lambda f: is_finite(f["metrics"]["vmaf"])
    )
    if strict:
        name = F.concat_ws(" ", F.lit(NO_SCORES), F.lit("for"), *[F.col(k).cast("string") for k in keys])
        missing = F.raise_error(name).cast(df.select(usable).schema[0].dataType)
        usable = F.when(F.size(usable) > 0, usable).otherwise(missing)
    frames = df.select(*keys, F.explode_outer(usable).alias("_frame"))
    rows = frames.select(
        *keys,
        F.col("_frame")["frameNum"].alias("frame"),
        F.col("_frame")["metrics"]["vmaf"].alias("score"),
    )
    return rows if strict else rows.withColumn("problem", F.when(F.col("score").isNull(), F.lit(NO_SCORES)))
