"""Typed views of string cells: lenient numbers and the four dialects of truth values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("1", "true", "yes", "y")
FALSE_WORDS = ("0", "false", "no", "n")


def optional_double(c: Column) -> Column:
    """Number, or null for blank and unreadable cells."""
    return F.nullif(c.cast("string"), F.lit("")).try_cast("double")


def strict_double(c: Column) -> Column:
    """Number, null for blank cells; anything else unreadable is an error under ANSI."""
    return F.nullif(c.cast("string"), F.lit("")).cast("double")


def optional_long(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit("")).try_cast("long")


def _word(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def flag(c: Column) -> Column:
    """Two values: blank is false."""
    return F.coalesce(_word(c).isin(*TRUE_WORDS), F.lit(False))


def flag_or_null(c: Column) -> Column:
    """Blank is null, any other word but the true ones false."""
    return F.when(F.coalesce(_word(c), F.lit("")) != "", _word(c).isin(*TRUE_WORDS))


def flag_three_valued(c: Column) -> Column:
    """True and false words; everything else is null."""
    return F.when(_word(c).isin(*TRUE_WORDS), True).when(_word(c).isin(*FALSE_WORDS), False)


def number_text(c: Column, places: int = 6) -> Column:
    """Fixed decimals, rounded half to even; blank for null and NaN."""
    missing = c.isNull() | F.isnan(c.cast("double"))
    return F.when(missing, "").otherwise(F.format_string(f"%.{places}f", F.bround(c.cast("double"), places)))
