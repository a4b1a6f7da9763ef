"""Table schemas and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType()),
        T.StructField("mod_time", T.StringType()),
        T.StructField("blake3", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mod_time", T.StringType()),
        T.StructField("blake3", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("skip_reason", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("output_size", T.LongType()),
        T.StructField("recipe", T.StringType()),
        T.StructField("fidelity", T.StringType()),
        T.StructField("trashed_at", T.TimestampType()),
        T.StructField("reclaimed", T.IntegerType()),
        T.StructField("crf_hint", T.IntegerType()),
        T.StructField("crf_hint_preset", T.IntegerType()),
        T.StructField("projected_saving", T.LongType()),
    ]
)

LEDGER_DEFAULTS = {"state": "pending", "reclaimed": 0, "projected_saving": 0}

VIDEO_STREAM = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("color_transfer", T.StringType()),
        T.StructField("bit_rate", T.LongType()),
        T.StructField("has_dolby_vision", T.BooleanType()),
    ]
)

PROBE = T.StructType(
    [
        T.StructField("format_names", T.ArrayType(T.StringType())),
        T.StructField("duration_secs", T.DoubleType()),
        T.StructField("bit_rate", T.LongType()),
        T.StructField("video", T.ArrayType(VIDEO_STREAM)),
        T.StructField("audio_codecs", T.ArrayType(T.StringType())),
        T.StructField("subtitle_count", T.IntegerType()),
    ]
)

# One object of a listing, as the listing tools print it.
RAW_LISTING = T.StructType(
    [
        T.StructField("Path", T.StringType()),
        T.StructField("Size", T.LongType()),
        T.StructField("ModTime", T.StringType()),
        T.StructField("IsDir", T.BooleanType()),
        T.StructField("Hashes", T.MapType(T.StringType(), T.StringType())),
    ]
)

RAW_QUOTA = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("total", "used", "free", "trashed")]
)

# Probe tools print most numbers as text.
RAW_PROBE = T.StructType(
    [
        T.StructField(
            "format",
            T.StructType(
                [
                    T.StructField("format_name", T.StringType()),
                    T.StructField("duration", T.StringType()),
                    T.StructField("bit_rate", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "streams",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("codec_type", T.StringType()),
                        T.StructField("codec_name", T.StringType()),
                        T.StructField("width", T.IntegerType()),
                        T.StructField("height", T.IntegerType()),
                        T.StructField("color_transfer", T.StringType()),
                        T.StructField("bit_rate", T.StringType()),
                        T.StructField(
                            "side_data_list",
                            T.ArrayType(
                                T.StructType([T.StructField("side_data_type", T.StringType())])
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

RAW_SCORES = T.StructType(
    [
        T.StructField(
            "frames",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("frameNum", T.LongType()),
                        T.StructField(
                            "metrics", T.StructType([T.StructField("vmaf", T.DoubleType())])
                        ),
                    ]
                )
            ),
        )
    ]
)


def evolve(df: DataFrame, schema: T.StructType = LEDGER, defaults: dict | None = None) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks; keep every row and value.

    Columns ``df`` has beyond ``schema`` stay, at the end.
    """
    defaults = LEDGER_DEFAULTS if defaults is None else defaults
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        value = F.col(field.name).cast(field.dataType) if field.name in have else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        return value.cast(field.dataType).alias(field.name)

    known = {f.name for f in schema.fields}
    extra = [F.col(name) for name in df.columns if name not in known]
    return df.select(*[column(f) for f in schema.fields], *extra)
