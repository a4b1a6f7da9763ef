"""Path expressions. Paths are root-relative and use ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slimlake.functions.columns import col


def normalize(path) -> Column:
    """Without leading and trailing slashes."""
    return F.btrim(col(path), F.lit("/"))


def join(prefix, suffix) -> Column:
    """Join two normalised parts; an empty part leaves no slash behind."""
    return F.concat_ws(
        "/", F.nullif(normalize(prefix), F.lit("")), F.nullif(normalize(suffix), F.lit(""))
    )


def extension(path) -> Column:
    """Text after the last dot of the last segment; empty for ``.hidden`` names."""
    return F.regexp_extract(col(path), r"[^/]\.([^./]*)/*\z", 1)


def swap_extension(path, new_extension) -> Column:
    """Replace the extension, or add one where the name has none."""
    stem = F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*/*\z", "")
    return F.concat(stem, F.lit("."), col(new_extension))


def short_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def _segments(path) -> Column:
    return F.filter(F.split(col(path), "/"), lambda part: (part != "") & (part != "."))


def is_safe_relative(path) -> Column:
    """Whether the path can only land below the folder it is joined to."""
    parts = _segments(path)
    return (F.size(parts) > 0) & ~F.array_contains(parts, "..")


def safe_relative(path, strict: bool = True) -> Column:
    """The path without root and ``.`` parts; unsafe is an error, or null."""
    clean = F.array_join(_segments(path), "/")
    if not strict:
        return F.when(is_safe_relative(path), clean)
    refused = F.raise_error(F.concat(F.lit("no safe relative form: "), col(path)))
    return F.when(is_safe_relative(path), clean).otherwise(refused.cast("string"))


def like_literal(text: str) -> str:
    """Escape a literal for use inside a LIKE pattern with ``\\`` as escape."""
    return "".join("\\" + ch if ch in "\\%_" else ch for ch in text)
