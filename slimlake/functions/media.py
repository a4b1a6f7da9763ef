"""Expressions over the probe struct (``schemas.PROBE``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions.columns import col


def first_video(probe) -> Column:
    return F.try_element_at(col(probe)["video"], F.lit(1))


def is_hdr(stream) -> Column:
    stream = col(stream)
    return F.coalesce(stream["has_dolby_vision"], F.lit(False)) | F.coalesce(
        stream["color_transfer"].isin(*K.HDR_TRANSFERS), F.lit(False)
    )


def pixels(stream) -> Column:
    return col(stream)["width"].cast("long") * col(stream)["height"].cast("long")


def video_bit_rate(probe) -> Column:
    """The first stream's rate, else the container's."""
    return F.coalesce(first_video(probe)["bit_rate"], col(probe)["bit_rate"])


def is_lossless_codec(codec) -> Column:
    return F.coalesce(col(codec).isin(*K.LOSSLESS_VIDEO_CODECS), F.lit(False))


def is_already_lean(pixel_count, bit_rate) -> Column:
    """So few bits per pixel that another encode would not help; unknown is no."""
    per_pixel = col(bit_rate).cast("double") / col(pixel_count).cast("double")
    known = (col(pixel_count) > 0) & col(bit_rate).isNotNull()
    return F.coalesce(
        F.when(known, per_pixel < F.lit(K.MIN_BITS_PER_PIXEL_SEC)), F.lit(False)
    )


def score_model(width, height) -> Column:
    area = col(width).cast("long") * col(height).cast("long")
    return F.when(area > K.UHD_PIXELS, F.lit(K.UHD_MODEL)).otherwise(F.lit(K.HD_MODEL))
