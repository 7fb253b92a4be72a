"""Inverse-propensity and naive weights.

Every normalising constant is an aggregate per fold or stratum that is joined
back to the rows; a window over a fold would pull half of all rows into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.numeric import clipped
from counterpoise.operators.lookup import attach_group_stats
from counterpoise.session import stage

TRUNCATION = 1000.0


def _fold_constants(df: DataFrame, fold: str, *aggs: Column) -> DataFrame:
    """One row per fold, written: a handful of folds passes the planner's size check for a broadcast, any number is right."""
    return stage(df.groupBy(fold).agg(*aggs), "fold-constants")


def inverse_propensity_by_stratum(
    df: DataFrame, strata: Sequence[str], treatment: str = "s", fold: str = "fold", out: str = "f"
) -> DataFrame:
    """Cross-fitted closed-form minimiser of ``mean(S f^2 - 2 f)``: rows / treated rows of each stratum.

    Fitted on one fold, attached to the other. A stratum without treated rows
    in the fitting fold has no estimate: ``f`` is null there.
    """
    fitted = df.groupBy(*strata, fold).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(treatment) == 1).alias("_n1")
    ).select(
        *strata, (1 - F.col(fold)).alias(fold),
        F.when(F.col("_n1") > 0, F.col("_n") / F.col("_n1")).alias(out),
    )
    return attach_group_stats(df, fitted, [*strata, fold], "strata", "left")


def uncovered_units(df: DataFrame, f: str, by: Sequence[str]) -> DataFrame:
    """Units per group whose inverse propensity could not be estimated."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col(f).isNull()).alias("uncovered"))


def stabilized(
    df: DataFrame, f: str, treatment: str = "s", fold: str = "fold", out: str = "ipw", truncation: float = TRUNCATION
) -> DataFrame:
    """Clipped at 1, scaled to mean N/n1 over the treated, truncated, scaled again; 0 for the untreated.

    The mean over all units of a fold is 1 after the last step.
    """
    return stabilized_many(df, {out: f}, treatment, fold, truncation)


def stabilized_many(
    df: DataFrame, specs: dict[str, str], treatment: str = "s", fold: str = "fold", truncation: float = TRUNCATION
) -> DataFrame:
    """The same for several (weight, inverse propensity) pairs sharing their two aggregation passes."""
    is_treated = F.col(treatment) == 1
    # A unit without an estimate takes the smallest weight a probability can give.
    raw = {w: F.when(is_treated, F.greatest(F.coalesce(F.col(f), F.lit(1.0)), F.lit(1.0))) for w, f in specs.items()}
    n_over_n1 = F.count(F.lit(1)) / F.count_if(is_treated)
    first = _fold_constants(
        df, fold, n_over_n1.alias("_target"), *[(n_over_n1 / F.avg(raw[w])).alias(f"_a_{w}") for w in specs]
    )
    once = df.join(first, fold).withColumns(
        {w: clipped(raw[w] * F.col(f"_a_{w}"), high=truncation) for w in specs}
    )
    second = _fold_constants(once, fold, *[F.avg(w).alias(f"_b_{w}") for w in specs])
    twice = once.join(second, fold).withColumns(
        {w: F.coalesce(F.col(w) * F.col("_target") / F.col(f"_b_{w}"), F.lit(0.0)) for w in specs}
    )
    return twice.drop("_target", *[f"_a_{w}" for w in specs], *[f"_b_{w}" for w in specs])


def truncation_report(
    df: DataFrame, specs: dict[str, str], treatment: str = "s", fold: str = "fold", truncation: float = TRUNCATION
) -> DataFrame:
    """How many treated rows ``stabilized_many`` cuts at the truncation, and their share: ``weight, treated, cut, share``."""
    is_treated = F.col(treatment) == 1
    raw = {w: F.when(is_treated, F.greatest(F.coalesce(F.col(f), F.lit(1.0)), F.lit(1.0))) for w, f in specs.items()}
    n_over_n1 = F.count(F.lit(1)) / F.count_if(is_treated)
    scaled = df.join(_fold_constants(df, fold, *[(n_over_n1 / F.avg(raw[w])).alias(f"_a_{w}") for w in specs]), fold)
    cuts = {w: F.count_if(raw[w] * F.col(f"_a_{w}") > truncation) for w in specs}
    one = scaled.agg(F.count_if(is_treated).alias("treated"), *[c.alias(w) for w, c in cuts.items()])
    rows = [F.struct(F.lit(w).alias("weight"), F.col(w).alias("cut"), F.try_divide(F.col(w), F.col("treated")).alias("share")) for w in specs]
    return one.select("treated", F.inline(F.array(*rows))).select("weight", "treated", "cut", "share")


def self_normalized(
    df: DataFrame, f: str, treatment: str = "s", fold: str = "fold", out: str = "ipw", factor: Column | None = None
) -> DataFrame:
    """``S * max(f, 1)`` (times an optional factor) over its fold mean, zeros included."""
    value = F.when(F.col(treatment) == 1, F.coalesce(clipped(f, low=1.0), F.lit(1.0))).otherwise(0.0)
    if factor is not None:
        value = value * factor
    raw = df.withColumn(out, value)
    mean = _fold_constants(raw, fold, F.avg(out).alias("_mean"))
    return raw.join(mean, fold).withColumn(out, F.try_divide(F.col(out), F.col("_mean"))).drop("_mean")


def naive(df: DataFrame, treatment: str = "s", out: str = "naive") -> DataFrame:
    """``S / mean(S)``."""
    share = df.agg(F.avg(F.col(treatment).cast("double"))).first()[0]
    return df.withColumn(out, F.try_divide(F.col(treatment).cast("double"), F.lit(share)))
