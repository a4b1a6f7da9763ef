"""Lenient numbers, tool output lines and log redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions.columns import col


def parse_number(text, type_name: str = "double") -> Column:
    """The number a text holds, null when it holds none."""
    return col(text).try_cast(type_name)


def round_setting(value) -> Column:
    """Half-to-even whole number in 0..63; null when not a usable number."""
    number = col(value)
    usable = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf"))
    return F.when(usable, F.least(F.bround(number), F.lit(float(K.MAX_CRF))).cast("int"))


def setting_of_line(line) -> Column:
    """The setting a ``crf <number> ...`` line names, else null."""
    number = F.regexp_extract(F.trim(col(line)), r"\Acrf \s*(\S+)", 1)
    return round_setting(parse_number(number))


def last_setting(report) -> Column:
    """The verdict of a search report: its last usable line."""
    found = F.filter(
        F.transform(F.split(col(report), "\r?\n"), setting_of_line), lambda v: v.isNotNull()
    )
    return F.try_element_at(found, F.lit(-1))


def hash_lines(dump, strict: bool = True) -> Column:
    """The hash column of a frame-hash dump, in order, without its header.

    A dump without frames is an error, or null with ``strict`` off: two empty dumps
    must not count as agreeing.
    """
    lines = F.filter(
        F.split(col(dump), "\r?\n"), lambda x: ~x.startswith("#") & (F.trim(x) != "")
    )
    joined = F.array_join(
        F.transform(lines, lambda x: F.trim(F.substring_index(x, ",", -1))), "\n"
    )
    missing = F.raise_error(F.lit("a frame-hash dump without frames")).cast("string")
    return F.when(F.size(lines) > 0, joined).otherwise(missing if strict else F.lit(None).cast("string"))


def redact(line) -> Column:
    """Mask the word after any flag whose name suggests a secret."""
    words = "|".join(K.SECRET_WORDS)
    return F.regexp_replace(
        col(line),
        rf"(?i)(?<=\A|\s)(-\S*(?:{words})\S*\s+)('[^']*'|\"[^\"]*\"|\S+)",
        rf"$1{K.REDACTED}",
    )


def valid_state(state) -> Column:
    """The state itself; any text outside the known set is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce(col(state), F.lit("null"))))
    return F.when(col(state).isin(*K.STATES), col(state)).otherwise(unknown.cast("string"))
