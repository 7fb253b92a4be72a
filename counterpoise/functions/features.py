"""Feature expressions on strings, arrays, maps and flags. All are plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
MISSING_TEXT = "(missing)"
MISSING_RATING = -1


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_length(c: str | Column) -> Column:
    """Characters in a string, 0 for null."""
    return F.coalesce(F.length(_col(c)), F.lit(0))


def joined_length(c: str | Column) -> Column:
    """Characters of an array's elements joined by single spaces, 0 for null."""
    return F.coalesce(F.length(F.concat_ws(" ", _col(c))), F.lit(0))


def array_count(c: str | Column) -> Column:
    """Number of array elements, 0 for null."""
    return F.coalesce(F.size(_col(c)), F.lit(0))


def map_text_length(c: str | Column) -> Column:
    """Characters of all keys, then all non-null values, joined by spaces; 0 for null."""
    m = _col(c)
    joined = F.concat_ws(" ", F.map_keys(m), F.map_values(m))
    return F.when(m.isNotNull(), F.length(joined)).otherwise(0)


# Fixed replacements that turn a category label into a column suffix; order matters.
NAME_RULES = [(" and ", "_and_"), ("&", "and"), (",", ""), ("'", ""), ("-", "_"), (" ", "_")]


def normalize_name(value: str) -> str:
    """Column suffix for a category label, for building column names."""
    out = value.lower()
    for old, new in NAME_RULES:
        out = out.replace(old, new)
    return out


def normalized(c: str | Column) -> Column:
    """The same rule on a column of labels."""
    out = F.lower(_col(c))
    for old, new in NAME_RULES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def flag_label(c: str | Column) -> Column:
    """1.0 where a flag (boolean or 0/1) is set, 0.0 otherwise; null counts as not set."""
    return F.when(_col(c).cast("boolean"), 1.0).otherwise(0.0)


def star_prefixed(rating: str | Column, text: str | Column) -> Column:
    """``"N stars: text"``, singular for 1; null when the text is null."""
    n = _col(rating).cast("int")
    return F.concat(
        n.cast("string"), F.when(n == 1, F.lit(" star: ")).otherwise(F.lit(" stars: ")), _col(text)
    )


def rating_from_text(text: str | Column) -> Column:
    """Leading digit 1..5 as an int, else null."""
    t = _col(text)
    return F.when(t.rlike("^[1-5]"), F.substring(t, 1, 1).cast("int"))


def hide_when_untreated(treatment: str | Column, c: str | Column, placeholder) -> Column:
    """Outcome column that is only observed where the treatment is 1."""
    return F.when(_col(treatment) == 1, _col(c)).otherwise(F.lit(placeholder))


def present(c: str | Column) -> Column:
    """Neither null nor NaN."""
    value = _col(c)
    return value.isNotNull() & ~F.isnan(value)
