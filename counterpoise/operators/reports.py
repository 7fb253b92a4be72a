"""Summaries, balance tables and weighted outcome distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.session import stage

RATINGS = (1, 2, 3, 4, 5)


def count_summary(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Total rows, and rows and percentage for every named condition, in one pass."""
    n = F.count(F.lit(1))
    cells = [n.alias("total")]
    for name, condition in conditions.items():
        cells.append(F.count_if(condition).alias(f"n_{name}"))
        cells.append((F.count_if(condition) * 100.0 / n).alias(f"pct_{name}"))
    return df.agg(*cells)


def _long(df: DataFrame, names: Sequence[str], stats: Mapping[str, object], label: str) -> DataFrame:
    """Aggregate every column in one pass, then turn the single wide row into one row per column."""
    wide = df.agg(*[make(c).alias(f"{c}__{stat}") for c in names for stat, make in stats.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias(label), *[F.col(f"{c}__{stat}").alias(stat) for stat in stats])
            for c in names
        ]
    )
    return wide.select(F.inline(rows))


def column_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, minimum, maximum and sample standard deviation per column."""
    stats = {
        "mean": lambda c: F.avg(c),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "std": lambda c: F.stddev_samp(c),
    }
    return _long(df, names, stats, "column")


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value, ordered by value."""
    counts = stage(df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")), "value-counts")
    # The total comes from the counts: the rows are read once.
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return counts.withColumn("pct", F.try_divide(F.col("rows") * 100.0, F.lit(total))).orderBy(column)


def rating_pmf(df: DataFrame, rating: str = "rating", by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Distribution on 1..5 per group, zero-filled; all zeros when nothing falls on the support.

    One conditional sum per rating: the rows are reduced to one per group
    before any shuffle, and no support table has to be joined.
    """
    w = F.lit(1.0) if weight is None else weight
    sums = [F.coalesce(F.sum(F.when(F.col(rating) == r, w)), F.lit(0.0)).alias(f"_r{r}") for r in RATINGS]
    wide = df.groupBy(*by).agg(*sums)
    total = sum((F.col(f"_r{r}") for r in RATINGS[1:]), F.col(f"_r{RATINGS[0]}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(r).alias("rating"),
                F.when(total != 0, F.col(f"_r{r}") / total).otherwise(0.0).alias("p"),
            )
            for r in RATINGS
        ]
    )
    return wide.select(*by, F.inline(rows))


def weight_summary(df: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Per weight column: population mean, mean of the positive part, spread, maximum, non-zero count and share."""
    stats = {
        "mean": lambda c: F.avg(c),
        "mean_positive": lambda c: F.avg(F.when(F.col(c) > 0, F.col(c))),
        "std": lambda c: F.stddev_samp(c),
        "max": lambda c: F.max(c),
        "nonzero": lambda c: F.count_if(F.col(c) != 0),
        "nonzero_share": lambda c: F.count_if(F.col(c) != 0) / F.count(F.lit(1)),
    }
    return _long(df, weights, stats, "weight")


def balance_table(df: DataFrame, covariates: Sequence[str], treatment: str = "s") -> DataFrame:
    """Overall, treated and control mean of each covariate with their difference, largest first."""
    on, off = F.col(treatment) == 1, F.col(treatment) == 0
    stats = {
        "overall_mean": lambda c: F.avg(c),
        "treated_mean": lambda c: F.avg(F.when(on, F.col(c))),
        "control_mean": lambda c: F.avg(F.when(off, F.col(c))),
    }
    table = _long(df, covariates, stats, "covariate").withColumn(
        "difference", F.col("treated_mean") - F.col("control_mean")
    )
    return table.orderBy(F.abs("difference").desc(), "covariate")


def top_n(df: DataFrame, by: Column, n: int, tie: str) -> DataFrame:
    """First n rows by a descending expression, ties by a key."""
    return df.orderBy(by.desc(), tie).limit(n)


def counterfactual_means(df: DataFrame, weights: Sequence[str], outcome: str) -> DataFrame:
    """``sum(w*y) / sum(w)`` of an outcome under every weight column, in one pass."""
    stats = {
        "weighted_mean": lambda c: F.try_divide(F.sum(F.col(c) * F.col(outcome)), F.sum(c)),
        "total_weight": lambda c: F.sum(c),
    }
    return _long(df, weights, stats, "weight")


def counterfactual_pmf(df: DataFrame, weights: Sequence[str], rating: str = "rating") -> DataFrame:
    """Weighted distribution of the rating under every weight column.

    All sums come from one pass of ``len(weights) * 5`` partial aggregates, so
    the rows are never multiplied by the number of weights.
    """
    cells = [
        F.coalesce(F.sum(F.when(F.col(rating) == r, F.col(w))), F.lit(0.0)).alias(f"{w}__{r}")
        for w in weights for r in RATINGS
    ]
    rows = []
    for w in weights:
        total = sum((F.col(f"{w}__{r}") for r in RATINGS[1:]), F.col(f"{w}__{RATINGS[0]}"))
        rows += [
            F.struct(
                F.lit(w).alias("weight"), F.lit(r).alias("rating"),
                F.when(total != 0, F.col(f"{w}__{r}") / total).otherwise(0.0).alias("p"),
            )
            for r in RATINGS
        ]
    return df.agg(*cells).select(F.inline(F.array(*rows)))


def parse_report(df: DataFrame, rating: str = "rating", by: Sequence[str] = ()) -> DataFrame:
    """How many texts carried a rating that could be read."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count(rating).alias("parsed"))


def positive_share(df: DataFrame, by: str, flag: str) -> DataFrame:
    """Share of set flags per group (null counts as not set)."""
    return df.groupBy(by).agg(F.avg(F.when(F.col(flag) == 1, 1.0).otherwise(0.0)).alias("share"))


def ordered_preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A preview that is the same on every run."""
    return df.orderBy(*order).limit(n)

