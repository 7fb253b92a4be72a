"""Column selection, recoding and row filters that need more than one expression."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.features import UNKNOWN, normalize_name, present

# Values of one column that may become columns of their own.
MAX_CATEGORIES = 1_000


def columns_with_prefix(df: DataFrame, prefixes: Sequence[str], exclude: Iterable[str] = ()) -> list[str]:
    """Columns starting with any prefix, sorted, without the excluded ones."""
    drop = set(exclude)
    return sorted(c for c in df.columns if c.startswith(tuple(prefixes)) and c not in drop)


def without_columns(df: DataFrame, names: Iterable[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Drop named and prefixed columns, such as post-treatment attributes or weights."""
    drop = set(names)
    return df.select(*[c for c in df.columns if c not in drop and not (prefixes and c.startswith(tuple(prefixes)))])


def category_list(df: DataFrame, column: str = "category", most: int = MAX_CATEGORIES) -> list:
    """Distinct values in order, to become columns; more than ``most`` of them are refused, not collected. Nulls are left out."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values: too many to become columns")
    return sorted(values)


def one_hot(df: DataFrame, column: str, values: Iterable[str], prefix: str = "category_") -> DataFrame:
    """0/1 columns for a known list of values in one projection; rows of unknown category leave first."""
    known = df.filter(F.col(column) != UNKNOWN)
    flags = [
        F.when(F.col(column) == v, 1).otherwise(0).alias(prefix + normalize_name(v))
        for v in sorted(values) if v != UNKNOWN
    ]
    return known.select("*", *flags)


def plus_minus_one_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Numeric columns whose distinct values are exactly -1 and 1, found in one aggregate row."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [c for c, t in df.dtypes if t in numeric and (columns is None or c in set(columns))]
    if not names:
        return []
    checks = [
        (
            (F.min(c) == -1) & (F.max(c) == 1)
            & (F.count_if(F.col(c).isNull() | ~F.col(c).isin(-1, 1)) == 0)
        ).alias(c)
        for c in names
    ]
    row = df.agg(*checks).first()
    return [c for c in names if row[c]]


def recode_plus_minus_one(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """-1/+1 to 0/1 for the named columns."""
    chosen = set(columns)
    return df.select(*[((F.col(c) + 1) / 2).cast("int").alias(c) if c in chosen else F.col(c) for c in df.columns])


def with_valid_rating(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows whose rating is neither null nor NaN."""
    return df.filter(present(rating))


def invalid_rating_count(df: DataFrame, rating: str = "rating") -> DataFrame:
    """How many rows the rating filter keeps and removes, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~present(rating)).alias("removed"),
        F.count_if(present(rating)).alias("kept"),
    )


def nonzero_weight(df: DataFrame, weight: str) -> DataFrame:
    """Rows with a weight other than 0; negative weights stay."""
    return df.filter(F.col(weight) != 0)


def choose_weight(df: DataFrame, name: str, weight_columns: Sequence[str], out: str = "weight") -> DataFrame:
    """Keep one weight column under a common name; ``naive`` means 1 for every row."""
    if name == "naive":
        value: Column = F.lit(1.0)
    elif name in weight_columns and name in df.columns:
        value = F.col(name).cast("double")
    else:
        raise ValueError(f"unknown weight {name!r}; choose naive or one of {sorted(weight_columns)}")
    return df.withColumn(out, value).drop(*[c for c in weight_columns if c != out])


def treated(df: DataFrame, treatment: str = "s") -> DataFrame:
    return df.filter(F.col(treatment) == 1)


def untreated(df: DataFrame, treatment: str = "s") -> DataFrame:
    return df.filter(F.col(treatment) == 0)


def concat_by_name(*frames: DataFrame, fill_missing: bool = False) -> DataFrame:
    """Bag union by column name, optionally null-filling absent columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=fill_missing)
    return out
