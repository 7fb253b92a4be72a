"""Distances between distributions and the tables that report them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterpoise.operators.moments import Moments, moment_states, moments, principal_components, projected
from counterpoise.session import stage

# Defaults of the published divergence-curve score: grid size, scale, grid ends.
GRID, SCALE, GRID_EDGE = 25, 5.0, 1e-6


def wasserstein(pmfs: DataFrame, target: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1-D distance of each group's distribution on 1..5 to the target distribution.

    ``pmfs`` has ``by, rating, p`` and ``target`` ``rating, p``; five rows per
    group, so the running sums are over five rows. The five target rows are broadcast.
    """
    five = F.broadcast(target.select("rating", F.col("p").alias("_q")))
    diff = pmfs.join(five, "rating")
    below = W.partitionBy(*by).orderBy("rating").rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = diff.withColumn("_gap", F.abs(F.sum(F.col("p") - F.col("_q")).over(below)))
    return gap.groupBy(*by).agg(F.sum(F.when(F.col("rating") < 5, F.col("_gap"))).alias("wasserstein"))


def cluster_histogram(df: DataFrame, cluster: str, in_p: Column) -> DataFrame:
    """Share of each sample per cluster: ``cluster, p, q``; rows without ``in_p``, null included, belong to q."""
    in_p = F.coalesce(in_p, F.lit(False))
    sizes = [F.count_if(in_p).alias("_p"), F.count_if(~in_p).alias("_q")]
    total = df.agg(*sizes).first()
    return df.groupBy(F.col(cluster).alias("cluster")).agg(*sizes).select(
        "cluster", F.try_divide("_p", F.lit(total["_p"])).alias("p"), F.try_divide("_q", F.lit(total["_q"])).alias("q")
    )


def weighted_histograms(train: DataFrame, test: DataFrame, cluster: str, weights: Sequence[str]) -> DataFrame:
    """Per weight column, share of weight (q) and of test rows (p) in every cluster: ``weight, cluster, p, q``."""
    mine = train.groupBy(cluster).agg(*[F.sum(w).alias(w) for w in weights])
    theirs = test.groupBy(cluster).agg(F.count(F.lit(1)).alias("_p"))
    both = stage(theirs.join(mine, cluster, "full").na.fill(0), "histograms")
    total = both.agg(F.sum("_p").alias("_p"), *[F.sum(w).alias(w) for w in weights]).first()
    rows = [
        F.struct(
            F.lit(w).alias("weight"), F.col(cluster).alias("cluster"), (F.col("_p") / F.lit(total["_p"])).alias("p"),
            F.try_divide(F.col(w), F.lit(float(total[w]))).alias("q"),
        )
        for w in weights
    ]
    return both.select(F.inline(F.array(*rows)))


def divergence_curve(histogram: DataFrame, grid: int = GRID, scale: float = SCALE, by: Sequence[str] = ()) -> DataFrame:
    """Points ``(exp(-c KL(q|r)), exp(-c KL(p|r)))`` for mixtures r of the two histograms, corners included."""
    step = (1 - 2 * GRID_EDGE) / (grid - 1)
    lam = F.lit(GRID_EDGE) + F.col("point") * F.lit(step)
    # A fixed grid per cluster; clusters are a chosen number.
    mixed = histogram.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("lam", lam)
    r = F.col("lam") * F.col("p") + (1 - F.col("lam")) * F.col("q")
    kl = lambda a: F.sum(F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / r)).otherwise(0.0))
    curve = mixed.groupBy(*by, "point").agg(
        F.exp(-F.lit(scale) * kl("q")).alias("x"), F.exp(-F.lit(scale) * kl("p")).alias("y")
    )
    corner = lambda point, x, y: F.struct(F.lit(point).alias("point"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    ends = histogram.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(
        *by, F.inline(F.array(corner(-1, 1.0, 0.0), corner(grid, 0.0, 1.0)))
    )
    return curve.unionByName(ends)


def curve_area(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the curve's few points."""
    order = W.partitionBy(*by).orderBy("x", F.col("y").desc())
    piece = (F.col("x") - F.lag("x").over(order)) * (F.col("y") + F.lag("y").over(order)) / 2
    return curve.select(*by, piece.alias("piece")).groupBy(*by).agg(F.sum("piece").alias("score"))


def frontier_integral(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Twice the sum over clusters of the divergence frontier's closed form."""
    p, q = F.col("p"), F.col("q")
    term = (
        F.when(p == q, 0.0).when(p == 0, q / 4).when(q == 0, p / 4)
        .otherwise((p + q) / 4 - F.try_divide(p * q * (F.log(p) - F.log(q)), 2 * (p - q)))
    )
    return histogram.groupBy(*by).agg((2 * F.sum(term)).alias("frontier_integral"))


def divergence_frontier(df: DataFrame, cluster: str, in_p: Column, grid: int = GRID, scale: float = SCALE) -> DataFrame:
    """One row: area under the divergence curve and frontier integral."""
    histogram = stage(cluster_histogram(df, cluster, in_p), "histogram")
    frontier = frontier_integral(histogram).first()[0]
    return curve_area(divergence_curve(histogram, grid, scale)).withColumn("frontier_integral", F.lit(frontier))


def assign_clusters(
    df: DataFrame, vector: str, clusters: int, seed: int = 42, out: str = "cluster", *, share: float | None = None, starts: int = 1,
) -> DataFrame:
    """k-means cluster of an array column, for samples that come without one.

    With ``share`` the vectors are first reduced to the principal components that hold this part of the variance. Of
    ``starts`` runs the one with the least cost stays. Rows without a usable vector have no cluster then.
    """
    ready, reduced = df, vector
    if share is not None:
        state = moments(df, vector).get(0)
        if state is None:
            return df.withColumn(out, F.lit(None).cast("int"))
        ready, reduced = projected(df, vector, state.mean, principal_components(state, share), "_reduced"), "_reduced"
    ready = ready.withColumn("_v", array_to_vector(F.col(reduced).cast("array<double>")))
    fitted = ready if share is None and starts == 1 else stage(ready.where(F.col(reduced).isNotNull()).select(reduced), "cluster-vectors")
    if fitted is not ready:
        fitted = fitted.withColumn("_v", array_to_vector(reduced))
    models = [KMeans(featuresCol="_v", predictionCol=out, k=clusters, seed=seed + i, maxIter=20).fit(fitted) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    if share is None:
        return model.transform(ready).drop("_v")
    return nearest_centre(ready.drop("_v"), reduced, np.array(model.clusterCenters()), out).drop("_reduced")


def nearest_centre(df: DataFrame, vector: str, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """Number of the nearest of a chosen set of centres (ties: the smaller); null where the vector is null."""
    model = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def run(batches):
        for batch in batches:
            raw, points = batch.column("_x"), model.value
            valid = raw.is_valid().to_numpy(zero_copy_only=False)
            x = raw.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, points.shape[1])
            found = np.zeros(batch.num_rows, dtype=np.int32)
            step = max(1, (1 << 20) // points.size)
            nearest = [((x[i : i + step, None] - points) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), step)]
            found[valid] = np.concatenate(nearest) if nearest else 0
            yield batch.drop_columns(["_x"]).append_column(out, pa.array(found, mask=~valid))

    kept = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` int"
    return df.select(*[f"`{f.name}`" for f in kept], F.col(vector).cast("array<double>").alias("_x")).mapInArrow(run, schema)


def feature_moments(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of every coordinate: ``by, i, mean, std``, partially aggregated per task."""
    return (
        df.select(*by, F.posexplode(vector).alias("i", "x"))
        .groupBy(*by, "i")
        .agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    )


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """Sample covariance in long form ``i, j, cov``, from one pass over the rows."""
    state = moment_states(df, vector).select("scatter", F.size("mean").alias("d"), F.greatest(F.col("weight") - 1, F.lit(1.0)).alias("n1"))
    row = lambda i: F.transform(F.sequence(i, F.col("d") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.col("d") - 1), row))
    upper = state.select("n1", F.inline(F.arrays_zip(places.alias("at"), F.col("scatter").alias("total"))))
    upper = upper.select("at.i", "at.j", (F.col("total") / F.col("n1")).alias("cov"))
    return upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def frechet_diagonal(df: DataFrame, vector: str, in_first: Column) -> DataFrame:
    """``sum((m1-m2)^2 + (s1-s2)^2)`` over coordinates: the distance with diagonal covariances."""
    x = df.select(in_first.alias("_first"), F.posexplode(vector).alias("i", "x"))
    one, two = F.when(F.col("_first"), F.col("x")), F.when(~F.col("_first"), F.col("x"))
    per = x.groupBy("i").agg(
        F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.stddev_samp(one).alias("s1"), F.stddev_samp(two).alias("s2")
    )
    return per.agg(
        F.sum((F.col("m1") - F.col("m2")) ** 2 + (F.col("s1") - F.col("s2")) ** 2).alias("frechet_diagonal")
    )


def frechet_between(first: Moments, second: Moments) -> float:
    """Full distance of two samples from their moments."""
    c1, c2 = first.covariance(), second.covariance()
    values, vectors = np.linalg.eigh(c1)
    root = (vectors * np.sqrt(values.clip(min=0))) @ vectors.T
    cross = np.sqrt(np.linalg.eigvalsh(root @ c2 @ root).clip(min=0)).sum()
    return float(((first.mean - second.mean) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)


def frechet(first: DataFrame, second: DataFrame, vector: str) -> float:
    """Full distance; each sample is read once and reduced to d means and a d x d matrix before the driver sees it."""
    return frechet_between(moments(first, vector)[0], moments(second, vector)[0])


def frechet_within(df: DataFrame, vector: str, in_first: Column) -> float:
    """Full distance between the rows with and without ``in_first`` of one table, read once; nulls belong to neither."""
    both = moments(df, vector, by=in_first)
    return frechet_between(both[True], both[False])


def region_weighted_mean(error: str | Column, mask: str | Column, boost: float = 8.0) -> Column:
    """``mean((1 + 8 m) e) / mean(1 + 8 m)`` over the positions of two array columns, without exploding them."""
    e = F.col(error) if isinstance(error, str) else error
    m = F.col(mask) if isinstance(mask, str) else mask
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    position = lambda x: F.lit(1.0) + F.lit(boost) * x
    return F.try_divide(total(F.zip_with(e, m, lambda a, b: a * position(b))), total(F.transform(m, position)))


def metric_table(rows: Sequence[DataFrame], metrics: Sequence[str], by: str = "weight") -> DataFrame:
    """Long metric frames ``by, metric, value`` as one row per model; the metric names are known, so no extra pass."""
    union = rows[0]
    for frame in rows[1:]:
        union = union.unionByName(frame)
    return union.groupBy(by).pivot("metric", list(metrics)).agg(F.first("value"))
