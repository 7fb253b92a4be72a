"""Deterministic splits, folds, shuffles, samples and chunks keyed on the row id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterpoise.functions.hashing import keyed_uniform
from counterpoise.session import stage

# Fixed shares of the four-way design split.
SPLIT_SHARES = {"propensity": 0.1, "half_a": 0.3, "half_b": 0.3, "test": 0.3}

# Rows of one rank bucket, which one task sorts; an upper limit on buckets keeps
# the running total over bucket sizes a small single-task window.
_BUCKET_ROWS = 1_000_000
_MAX_BUCKETS = 65_536


def assign_split(
    df: DataFrame, unit_id: str = "unit_id", shares: Mapping[str, float] | None = None, seed: int = 42, out: str = "split",
) -> DataFrame:
    """Disjoint half-open intervals of a keyed uniform, in one narrow pass."""
    shares = dict(shares or SPLIT_SHARES)
    u = keyed_uniform(unit_id, "split", seed)
    names = list(shares)
    label, upper = None, 0.0
    for name in names[:-1]:
        upper = round(upper + shares[name], 12)
        label = F.when(u < upper, name) if label is None else label.when(u < upper, name)
    last = F.lit(names[-1])
    return df.withColumn(out, last if label is None else label.otherwise(last))


def split_report(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and share per split; the shares of all splits add up to 1."""
    counts = stage(df.groupBy(split).agg(F.count(F.lit(1)).alias("rows")), "split-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return counts.withColumn("share", F.try_divide("rows", F.lit(total)))


def random_fold(df: DataFrame, unit_id: str = "unit_id", seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold 0 or 1 by a fair keyed coin."""
    return df.withColumn(out, F.when(keyed_uniform(unit_id, "fold", seed) < 0.5, 0).otherwise(1))


def shuffled_rank(
    df: DataFrame, unit_id: str = "unit_id", seed: int = 42, out: str = "rn", by: Sequence[str] = (), purpose: str = "order"
) -> DataFrame:
    """1-based position in the seeded random order (per ``by`` group), without a global sort task.

    Rows go to equal-width buckets of the keyed uniform; a running total over
    the bucket sizes gives each bucket's offset, so only rows of one bucket
    are ever ranked together. Hash buckets are even by construction, also
    inside a group that holds most of the rows.
    """
    by = list(by)
    buckets = int(min(_MAX_BUCKETS, max(1, -(-df.count() // _BUCKET_ROWS))))
    keyed = df.withColumn("_u", keyed_uniform(unit_id, purpose, seed)).withColumn(
        "_bucket", F.floor(F.col("_u") * buckets).cast("int")
    )
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*by, "_bucket").orderBy("_u", unit_id)
    ranked = keyed.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(stage(offsets, "rank-offsets"), [*by, "_bucket"])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("long"))
        .drop("_u", "_bucket", "_rn", "_offset")
    )


def exact_halves(df: DataFrame, unit_id: str = "unit_id", seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold 0 is the first floor(n/2) rows of the seeded order, fold 1 the rest."""
    half = df.count() // 2
    ranked = shuffled_rank(df, unit_id, seed, "_rank", purpose="fold")
    return ranked.withColumn(out, F.when(F.col("_rank") <= half, 0).otherwise(1)).drop("_rank")


def shuffled(df: DataFrame, unit_id: str = "unit_id", seed: int = 42) -> DataFrame:
    """Seeded full shuffle as a range-partitioned sort."""
    return df.orderBy(keyed_uniform(unit_id, "order", seed), F.col(unit_id))


def sample_n(df: DataFrame, n: int, unit_id: str = "unit_id", seed: int = 42, top_rows: int = 100_000) -> DataFrame:
    """Exactly min(n, rows) rows of the seeded order.

    Only rows whose uniform lies below a cut that surely holds n rows are
    ordered (the count is checked, otherwise all rows are). A small n is then
    a top-n; a large one filters on the distributed rank, because a top-n
    merges its rows in one place.
    """
    cut = (n + 10 * n**0.5 + 100) / max(df.count(), 1)
    rows = df
    if cut < 1:
        low = df.filter(keyed_uniform(unit_id, "order", seed) < cut)
        rows = low if low.count() >= n else df
    if n <= top_rows:
        return shuffled(rows, unit_id, seed).limit(n)
    return shuffled_rank(rows, unit_id, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def equal_size(df: DataFrame, side: str, unit_id: str = "unit_id", seed: int = 42) -> DataFrame:
    """Cut every side to the size of the smallest, keeping the first rows of the seeded order."""
    smallest = df.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n")).first()[0] or 0
    return shuffled_rank(df, unit_id, seed, "_rank", by=[side]).filter(F.col("_rank") <= smallest).drop("_rank")


def assign_chunk(df: DataFrame, chunks: int, unit_id: str = "unit_id", seed: int = 42, out: str = "chunk") -> DataFrame:
    """Contiguous chunks of the seeded order of floor(n/chunks) rows; the last takes the remainder."""
    size = max(df.count() // chunks, 1)
    ranked = shuffled_rank(df, unit_id, seed, "_rank")
    position = F.floor((F.col("_rank") - 1) / F.lit(size)).cast("int")
    return ranked.withColumn(out, F.least(position, F.lit(chunks - 1))).drop("_rank")
