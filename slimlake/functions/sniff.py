"""What the leading bytes say, in built-in binary expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions.columns import col


def head_of(content) -> Column:
    """The leading bytes that all tests here look at."""
    return F.substring(col(content), 1, K.HEAD_BYTES)


def _at(head, offset: int, *choices: bytes) -> Column:
    """Whether the bytes at ``offset`` are one of ``choices`` (of equal length)."""
    found = F.substring(col(head), offset + 1, len(choices[0]))
    return found.isin([bytearray(c) for c in choices])


def sniff_image(head) -> Column:
    """Image format named by the bytes; null when they name none."""
    headers = [size.to_bytes(4, "little") for size in K.BMP_HEADER_SIZES]
    brands = [brand.encode() for brand in K.HEIF_BRANDS]
    tests = {
        "png": _at(head, 0, b"\x89PNG\r\n\x1a\n"),
        "jpeg": _at(head, 0, b"\xff\xd8\xff"),
        "gif": _at(head, 0, b"GIF8"),
        "webp": _at(head, 0, b"RIFF") & _at(head, 8, b"WEBP"),
        "tiff": _at(head, 0, b"II*\x00", b"MM\x00*"),
        "bmp": _at(head, 0, b"BM") & _at(head, 14, *headers),
        "heif": _at(head, 4, b"ftyp") & _at(head, 8, *brands),
        "jxl": _at(head, 0, b"\xff\x0a")
        | _at(head, 0, b"\x00\x00\x00\x0cJXL \x0d\x0a\x87\x0a"),
    }
    named = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        named = F.when(test, F.lit(name)).otherwise(named)
    return named


def is_lossless_webp(head) -> Column:
    """The plain lossless form only; the extended form counts as not lossless."""
    return F.coalesce(
        _at(head, 0, b"RIFF") & _at(head, 8, b"WEBP") & _at(head, 12, b"VP8L"), F.lit(False)
    )


def is_mpeg_ts(head) -> Column:
    """A sync byte at the start of each of the first packets, all of them present."""
    sync = bytes([K.TS_SYNC])
    starts = [_at(head, i * K.TS_PACKET, sync) for i in range(K.TS_PACKETS_CHECKED)]
    enough = F.octet_length(col(head)) >= K.TS_PACKET * K.TS_PACKETS_CHECKED
    return F.coalesce(reduce(lambda a, b: a & b, starts, enough), F.lit(False))
