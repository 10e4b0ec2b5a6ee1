"""Column functions for text handling (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens import config as C



def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim`` with an explicit character set (every ``str.isspace()``
    character) only touches the two ends of the string, unlike a regex.
    """
    return F.trim(col_(c), F.lit(C.PY_WHITESPACE_CHARS))


def or_empty(c: Column | str) -> Column:
    """``x or ""`` for a string: NULL becomes the empty string."""
    return F.coalesce(col_(c), F.lit(""))


def non_empty(c: Column | str) -> Column:
    """Truthiness of a Python string: not NULL and not empty."""
    c = col_(c)
    return c.isNotNull() & (F.length(c) > 0)


def truncate(c: Column | str, max_len: int | None, suffix: str = C.TRUNCATION_SUFFIX) -> Column:
    """First ``max_len`` code points plus a marker when the text is longer (None: the whole text)."""
    c = col_(c)
    if max_len is None:
        return c
    return F.when(F.length(c) > F.lit(max_len),
                  F.concat(F.substring(c, 1, max_len), F.lit(suffix))).otherwise(c)


def cap(c: Column | str, max_chars: int | None) -> Column:
    """Hard cap without a marker (0 / None = no cap)."""
    c = col_(c)
    if not max_chars:
        return c
    return F.substring(c, 1, max_chars)


def id_text(c: Column | str) -> Column:
    """``str(x or "")`` for an integer id: NULL and 0 both give ``""``."""
    c = col_(c)
    return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))


def name_of(obj: Column | str, default: str = "") -> Column:
    """``(obj or {}).get("name") or default`` for a ``{id, name}`` struct."""
    obj = col_(obj)
    name = obj.getField("name")
    return F.when(non_empty(name), name).otherwise(F.lit(default))


def first_line(c: Column | str) -> Column:
    """Text up to the first line break (whole text when there is none)."""
    return F.substring_index(col_(c), "\n", 1)


def elapsed_seconds(end: Column | str, start: Column | str) -> Column:
    """``end - start`` in seconds for TIMESTAMP or TIMESTAMP_NTZ (read as UTC),
    from the exact microsecond difference."""
    us = F.unix_micros(col_(end).cast("timestamp")) - F.unix_micros(col_(start).cast("timestamp"))
    return us / F.lit(1_000_000.0)
