"""Tidy forms of identifiers. All are null for null and never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer blanks.
BLANKS = " \t\r\n "


def trimmed(col: Column | str) -> Column:
    """Without outer blanks."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def key(col: Column | str) -> Column:
    """Key form: without outer blanks, upper case."""
    return F.upper(trimmed(col))


def filled(col: Column | str) -> Column:
    """Key form, with blank turned into null."""
    return F.nullif(key(col), F.lit(""))


def cell_key(sample: Column | str, slice_: Column | str, cellbin: Column | str) -> Column:
    """``sample|slice|cellbin``; null if any part is null."""
    return F.concat(key(sample), F.lit("|"), key(slice_), F.lit("|"), key(cellbin))


def feature_key(assay: Column | str, feature: Column | str) -> Column:
    """``assay::feature``; null if either part is null."""
    return F.concat(key(assay), F.lit("::"), key(feature))


def month(col: Column | str) -> Column:
    """``yyyy-MM`` of a time, ``unknown`` for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.substring(c.cast("string"), 1, 7), F.lit("unknown"))
