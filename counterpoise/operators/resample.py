"""Weighted resampling with replacement through a distributed prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterpoise.functions.hashing import keyed_uniform
from counterpoise.functions.numeric import is_infinite, usable_weight
from counterpoise.session import stage

# Weights are summed as decimals: sums then do not depend on task order, so a
# recomputed task gives the same interval bounds.
_EXACT = "decimal(28,12)"
_BUCKET_ROWS = 1_000_000
_MAX_BUCKETS = 65_536


def weight_quality(df: DataFrame, weight: str) -> DataFrame:
    """Counts of negative, NaN and infinite weights in one pass."""
    w = F.col(weight)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(w < 0).alias("negative"),
        F.count_if(F.isnan(w)).alias("nan"),
        F.count_if(is_infinite(w)).alias("infinite"),
    )


def sanitized(df: DataFrame, weight: str, out: str = "w") -> DataFrame:
    """Unusable weights to 0; a uniform weight of 1 for all when nothing is left."""
    clean = df.withColumn(out, usable_weight(weight))
    total = clean.agg(F.sum(out)).first()[0]
    return clean if total else clean.withColumn(out, F.lit(1.0))


def cumulative_intervals(
    df: DataFrame, weight: str, unit_id: str = "unit_id", seed: int = 42, points: DataFrame | None = None, point: str = "u"
) -> DataFrame:
    """Half-open intervals ``[lo, hi)`` of [0, 1) whose lengths are proportional to the weights.

    Intervals follow the seeded random order of the units. Rows of one range
    of that order are summed up in one task, ranges are even by construction,
    and their offsets come from a running total over at most ``_MAX_BUCKETS``
    sums. Rows of weight 0 get no interval. With ``points`` only ranges that
    hold one of them are ordered and shuffled; the others have no interval.
    """
    rows = df.filter(F.col(weight) > 0)
    n, mass = rows.agg(F.count(F.lit(1)), F.sum(weight)).first()
    buckets = int(min(_MAX_BUCKETS, max(8, -(-n // _BUCKET_ROWS))))
    # Scaled to mean 1, so twelve decimals are fine whatever unit the weights have.
    scaled = (F.col(weight) * F.lit(n / mass if mass else 1.0)).cast(_EXACT)
    keyed = rows.withColumns({"_w": scaled, "_u": keyed_uniform(unit_id, "layout", seed)}).withColumn(
        "_b", F.floor(F.col("_u") * buckets).cast("int")
    )
    sums = stage(keyed.groupBy("_b").agg(F.sum("_w").alias("_sum")), "bucket-sums")
    before = W.partitionBy().orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("decimal(38,12)")).alias("_offset"), "_sum"
    )
    total = sums.agg(F.sum("_sum").cast("double")).first()[0] or 1.0
    if points is not None:
        # One row per bucket, never more than _MAX_BUCKETS; a bucket's ends are its first and last interval's ends.
        low, high = F.col("_offset").cast("double") / F.lit(total), (F.col("_offset") + F.col("_sum")).cast("double") / F.lit(total)
        ends = offsets.select("_b", low.alias("_low"), high.alias("_high"))
        hit = interval_join(points, ends, point, "_low", "_high", buckets).select("_b").distinct()
        offsets = offsets.join(stage(hit, "hit-buckets"), "_b", "left_semi")
        keyed = keyed.join(F.broadcast(offsets.select("_b")), "_b", "left_semi")
    offsets = offsets.drop("_sum")
    inside = W.partitionBy("_b").orderBy("_u", unit_id).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = keyed.withColumn("_upto", F.sum("_w").over(inside))
    # One offset row per bucket, never more than _MAX_BUCKETS.
    placed = running.join(F.broadcast(offsets), "_b")
    end = F.col("_offset") + F.col("_upto")
    return placed.withColumns(
        {"lo": (end - F.col("_w")).cast("double") / F.lit(total), "hi": end.cast("double") / F.lit(total)}
    ).drop("_w", "_u", "_b", "_upto", "_offset")


def uniform_draws(spark, n: int, seed: int = 42) -> DataFrame:
    """Independent uniform draws, each fixed by its number and the seed."""
    return spark.range(n).select(F.col("id").alias("draw"), keyed_uniform("id", "draw", seed).alias("u"))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, grid: int) -> DataFrame:
    """Points in [0, 1) joined to the intervals ``lo <= point < hi`` through an equi-join on grid cells.

    An interval is copied to the grid cells it overlaps: over disjoint
    intervals that is at most rows + ``grid`` copies in all, and a long
    interval is spread over as many join keys.
    """
    cell = F.least(F.floor(F.col(point) * grid), F.lit(grid - 1))
    first = F.least(F.floor(F.col(lo) * grid), F.lit(grid - 1))
    last = F.least(F.floor(F.col(hi) * grid), F.lit(grid - 1))
    left = points.withColumn("_cell", cell)
    right = intervals.withColumn("_cell", F.explode(F.sequence(first, last)))
    inside = (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))
    return left.join(right, "_cell").filter(inside).drop("_cell")


def weighted_resample(
    df: DataFrame, weight: str, n: int = 10_000, unit_id: str = "unit_id", seed: int = 42
) -> DataFrame:
    """n independent draws with replacement, probability proportional to the usable weight."""
    clean = sanitized(df, weight, "_weight")
    draws = uniform_draws(df.sparkSession, n, seed)
    intervals = cumulative_intervals(clean, "_weight", unit_id, seed, draws)
    return interval_join(draws, intervals, "u", "lo", "hi", max(n, 1)).drop("u", "lo", "hi", "_weight")


def draw_counts(sample: DataFrame, unit_id: str = "unit_id") -> DataFrame:
    """Draws per unit."""
    return sample.groupBy(unit_id).agg(F.count(F.lit(1)).alias("draws"))


def resample_summary(sample: DataFrame, unit_id: str = "unit_id") -> DataFrame:
    """Unique units and largest, smallest and mean number of draws."""
    return draw_counts(sample, unit_id).agg(
        F.count(F.lit(1)).alias("unique_units"), F.max("draws").alias("max_draws"),
        F.min("draws").alias("min_draws"), F.avg("draws").alias("mean_draws"),
    )


def draw_histogram(sample: DataFrame, unit_id: str = "unit_id") -> DataFrame:
    """How many units were drawn once, twice and so on."""
    return draw_counts(sample, unit_id).groupBy("draws").agg(F.count(F.lit(1)).alias("units"))
