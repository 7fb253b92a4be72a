"""Propensity models with MLlib, cross-fitted scoring and closed-form inverse propensities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.features import flag_label
from counterpoise.functions.hashing import keyed_uniform
from counterpoise.functions.numeric import LOGIT_SHIFT, clipped, shifted_probability
from counterpoise.operators import boosting
from counterpoise.operators.moments import moments
from counterpoise.session import stage

LABEL = "_label"
# Probabilities are kept off 0 before they are inverted.
_P_MIN = 1e-6
# Rows of one boosting task, and the bins of a feature.
_BOOSTING_ROWS, _BINS = 100_000, 64


def specification(features: Sequence[str], indicators: Sequence[str]) -> dict[str, list[str]]:
    """Right specification: all features. Wrong: without the category indicators."""
    drop = set(indicators)
    return {"right": [*features, *[c for c in indicators if c not in features]], "wrong": [c for c in features if c not in drop]}


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows without null or NaN features, filtered before anything is counted."""
    return df.na.drop(subset=list(features))


def fit_logistic(df: DataFrame, features: Sequence[str], flag: str = "s") -> PipelineModel:
    """L2 logistic regression on z-scored features; a null flag counts as 0."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_features", labelCol=LABEL, maxIter=100, regParam=0.01, elasticNetParam=0.0, tol=1e-6,
            fitIntercept=True, standardization=False, probabilityCol="_probability", rawPredictionCol="_raw_prediction",
            predictionCol="_prediction",
        ),
    ]
    return Pipeline(stages=stages).fit(df.withColumn(LABEL, flag_label(flag)))


def fit_boosted(
    df: DataFrame, features: Sequence[str], flag: str = "s", *, trees: int = 100, rate: float = 0.1, depth: int = 5,
    min_rows: int = 20, row_share: float = 0.8, feature_share: float = 0.8, seed: int = 42,
    validation: str | None = None,
) -> PipelineModel | boosting.Ensemble:
    """Gradient-boosted propensity with logistic loss.

    Depth 5 gives trees of up to 32 leaves. The model is MLlib's, grown by ``boosting``, whose passes read rows alike in bins
    once. ``validation`` names a boolean column; its rows stop the boosting early instead of training it, by MLlib itself.
    Rows with a null or NaN feature are left out.
    """
    if not validation:
        settings = boosting.Candidate(depth, rate, trees, min_rows, None, row_share, feature_share, seed)
        return _grown(complete_rows(df.select(*dict.fromkeys([*features, flag])), features), features, [settings], flag).models[0]
    gbt = GBTClassifier(
        featuresCol="_features", labelCol=LABEL, maxIter=trees, stepSize=rate, maxDepth=depth, maxBins=_BINS,
        minInstancesPerNode=min_rows, subsamplingRate=row_share, featureSubsetStrategy=str(feature_share), seed=seed,
        predictionCol="_prediction", validationIndicatorCol=validation,
    )
    gbt = gbt.setProbabilityCol("_probability").setRawPredictionCol("_raw_prediction")
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), gbt]
    # Boosting runs a job per level of every tree: its tasks should hold enough rows to be worth starting.
    rows = df.select(*dict.fromkeys([*features, flag, validation]))
    rows = rows.repartition(max(1, math.ceil(rows.count() / _BOOSTING_ROWS)))
    return Pipeline(stages=stages).fit(rows.withColumn(LABEL, flag_label(flag)))


def _grown(rows: DataFrame, features: Sequence[str], settings: list[boosting.Candidate], flag: str, part: str | None = None) -> boosting.Search:
    found = boosting.search(rows, features, settings, flag, loss="deviance", part=part, max_bins=_BINS)
    if not all(found.grown):
        raise ValueError("no complete row to fit")
    return found


def score(model: PipelineModel | LogisticFit | boosting.Ensemble, df: DataFrame, out: str = "p") -> DataFrame:
    """Original columns plus the probability of class 1; of MLlib's models taken from the vector without a UDF."""
    if isinstance(model, LogisticFit):
        return model.score(df, out)
    if isinstance(model, boosting.Ensemble):
        return model.score(complete_rows(df, model.binning.features), out)
    return model.transform(df).select(*df.columns, vector_to_array("_probability")[1].alias(out))


def score_shifted(model: PipelineModel | LogisticFit, df: DataFrame, out: str = "p", shift: float = LOGIT_SHIFT) -> DataFrame:
    """Scored rows with the logit-shifted probability of the semi-synthetic design."""
    return score(model, df, out).withColumn(out, shifted_probability(out, shift))


def coefficient_ranking(model: PipelineModel | LogisticFit, features: Sequence[str], n: int | None = None) -> DataFrame:
    """Coefficients by absolute size; as many rows as the model has features."""
    values = [float(x) for x in (model if isinstance(model, LogisticFit) else model.stages[-1]).coefficients]
    ranked = SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, coefficient double").orderBy(
        F.abs("coefficient").desc(), "feature"
    )
    return ranked if n is None else ranked.limit(n)


def score_equations(model: PipelineModel, df: DataFrame, flag: str = "s", ridge: float = 0.01) -> DataFrame:
    """Gradient of the penalised likelihood at the fitted coefficients; all entries are close to 0."""
    fitted = model.stages[-1]
    scored = model.transform(df.withColumn(LABEL, flag_label(flag)))
    residual = vector_to_array("_probability")[1] - F.col(LABEL)
    x = vector_to_array("_features")
    names = model.stages[0].getInputCols()
    cells = [
        F.struct(F.lit(n).alias("feature"), (F.avg(residual * x[i]) + ridge * float(fitted.coefficients[i])).alias("gradient"))
        for i, n in enumerate(names)
    ]
    cells.append(F.struct(F.lit("(intercept)").alias("feature"), F.avg(residual).alias("gradient")))
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def crossfit_scores(df: DataFrame, fit, fold: str = "fold", out: str = "p", treated: str | None = None) -> DataFrame:
    """Fit on each fold, score the other; every row gets one out-of-fold probability.

    With ``treated`` only the rows whose flag is 1 are scored: others have weight 0 whatever their probability.
    """
    halves = []
    for f in (0, 1):
        model = fit(df.filter(F.col(fold) == f))
        other = df.filter(F.col(fold) == 1 - f)
        halves.append(score(model, other if treated is None else other.filter(F.col(treated) == 1), out))
    return halves[0].unionByName(halves[1])


def crossfit_boosted(
    df: DataFrame, features: Sequence[str], flag: str = "s", *, fold: str = "fold", out: str = "p", treated: str | None = None, trees: int = 100,
    rate: float = 0.1, depth: int = 5, min_rows: int = 20, row_share: float = 0.8, feature_share: float = 0.8, seed: int = 42,
) -> DataFrame:
    """``crossfit_scores`` with the models of ``fit_boosted``; those of both folds grow in the same passes."""
    settings = [boosting.Candidate(depth, rate, trees, min_rows, f, row_share, feature_share, seed) for f in (0, 1)]
    found = _grown(complete_rows(df, features), features, settings, flag, fold)
    halves = []
    for f in (0, 1):
        other = df.filter(F.col(fold) == 1 - f)
        halves.append(score(found.best(f), other if treated is None else other.filter(F.col(treated) == 1), out))
    return halves[0].unionByName(halves[1])


def inverse(p: str, least: float = _P_MIN):
    """Reciprocal of a probability kept at ``least`` or above; null stays null."""
    return 1.0 / clipped(p, low=least)


def below(df: DataFrame, p: str, least: float = _P_MIN) -> DataFrame:
    """How many probabilities ``inverse`` raises to ``least``."""
    return df.agg(F.count(p).alias("scored"), F.count(F.when(F.col(p) < least, 1)).alias("raised"))


def tune_boosted(
    df: DataFrame, features: Sequence[str], flag: str = "s", *, depths: Sequence[int] = (3, 5), rates: Sequence[float] = (0.05, 0.1, 0.3), trees: int = 100,
    train_share: float = 0.8, key: str = "unit_id", seed: int = 42, loss: str = "logistic", patience: int = 10, halve_at: Sequence[int] = (10, 20, 40),
    part: str | None = None, parts: Sequence[int | None] = (None,), min_rows: int = 20, max_bins: int = 64,
) -> boosting.Search:
    """Search over depth and rate, for each of ``parts``, in one run of shared passes.

    The validation rows, drawn by ``key``, come from the fitting data itself. They stop every candidate early and halve the
    field at the tree numbers ``halve_at``; the best candidate's model is cut to its best tree number. ``loss`` is "logistic" for
    propensities, "inverse" for inverse propensities. On the driver are only the settings, the splits and one loss per tree.
    """
    grid = [boosting.Candidate(d, r, trees, min_rows, p) for p in parts for d in depths for r in rates]
    rows = df.withColumn("_validation", keyed_uniform(key, "validate", seed) >= train_share)
    return boosting.search(
        rows, features, grid, flag, loss=loss, validation="_validation", part=part, patience=patience, halve_at=halve_at, max_bins=max_bins,
    )


@dataclass(frozen=True)
class LogisticFit:
    """A fitted logistic model: coefficients of the z-scored features, and the steps and mean loss it took."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float
    steps: int
    loss: float

    def logit(self) -> Column:
        raw = self.coefficients / self.scale
        value = F.lit(float(self.intercept - self.mean @ raw))
        for c, b in zip(self.features, raw):
            value = value + F.col(c).cast("double") * F.lit(float(b))
        return value

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Rows without null or NaN features, with the probability of class 1; a plain expression."""
        return complete_rows(df, self.features).withColumn(out, 1.0 / (1.0 + F.exp(-self.logit())))


def newton_logistic(
    df: DataFrame, features: Sequence[str], flag: str = "s", *, ridge: float = 0.01, steps: int = 50, tol: float = 1e-10,
) -> LogisticFit:
    """The model of ``fit_logistic`` by reweighted least squares: one pass over the rows and d x d sums per step.

    A row's weight is p (1 - p), its response the working one, so the step is a weighted regression whose moments
    ``moments`` merges; the mean loss travels as one more coordinate, and a step that raises it is halved. Features are
    z-scored by the sample's own deviation; a constant feature has coefficient 0. Without ``ridge``, collinear features get
    the least coefficients that solve the equations. A null flag counts as 0; rows with a null or NaN feature are left out.
    """
    d = len(features)
    x = F.array(*[F.col(c).cast("double") for c in features], flag_label(flag).cast("double"))
    rows = stage(complete_rows(df, features).select(x.alias("x")), "logistic-rows")
    # A plain scan of files: its number of tasks is known without running it, and the same in every step.
    tasks = rows.rdd.getNumPartitions()
    first = moments(rows, "x", tasks=tasks).get(0)
    if first is None:
        raise ValueError("no complete row to fit")
    mean, scale = first.mean[:d], np.sqrt(np.diag(first.covariance())[:d])
    fixed = scale <= 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(fixed, 1.0, scale)

    def at(b: np.ndarray, b0: float):
        def prepare(x: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = np.where(fixed, 0.0, (x[:, :d] - mean) / scale)
            y, eta = x[:, d], z @ b + b0
            p = np.exp(-np.logaddexp(0.0, -eta))
            w = np.maximum(p * (1.0 - p), 1e-12)
            return np.column_stack([z, eta + (y - p) / w, (np.logaddexp(0.0, eta) - y * eta) / w]), w

        m = moments(rows, "x", prepare=prepare, tasks=tasks)[0]
        return m, float(m.weight * m.mean[-1] / m.n + ridge / 2.0 * (b @ b))

    b, b0 = np.zeros(d), 0.0
    state, loss = at(b, b0)
    taken = 0
    while taken < steps:
        taken += 1
        left = state.scatter[:d, :d] + ridge * state.n * np.eye(d)
        goal = np.linalg.lstsq(left, state.scatter[:d, d], rcond=1e-12)[0]
        goal0 = float(state.mean[d] - state.mean[:d] @ goal)
        share = 1.0
        while True:
            new, new0 = b + share * (goal - b), b0 + share * (goal0 - b0)
            new_state, new_loss = at(new, new0)
            if new_loss <= loss + 1e-12 or share < 1e-3:
                break
            share /= 2.0
        moved = max(np.abs(new - b).max(initial=0.0), abs(new0 - b0))
        b, b0, state, loss = new, new0, new_state, new_loss
        if moved <= tol * max(1.0, np.abs(b).max(initial=0.0), abs(b0)):
            break
    return LogisticFit(tuple(features), mean, scale, b, b0, taken, loss)


def riesz_linear(df: DataFrame, features: Sequence[str], treatment: str = "s", ridge: float = 1e-9) -> np.ndarray:
    """Coefficients (intercept first) of the linear minimiser of ``mean(S f^2 - 2 f)``: ``E[S x x'] b = E[x]``."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    rows = complete_rows(df, features)
    n, *means = rows.agg(F.count(F.lit(1)), *[F.avg(F.col(c).cast("double")) for c in features]).first()
    means, d = np.array([1.0, *means]), len(features) + 1
    left = moments(rows, x, treatment)[0].second() / n
    scale = np.sqrt(np.diag(left)).clip(min=1e-12)
    system = left / np.outer(scale, scale) + ridge * np.eye(d)
    return np.linalg.solve(system, means / scale) / scale


def apply_linear(df: DataFrame, features: Sequence[str], b: np.ndarray, out: str = "f") -> DataFrame:
    value = F.lit(float(b[0]))
    for c, weight in zip(features, b[1:]):
        value = value + F.col(c) * F.lit(float(weight))
    return df.withColumn(out, value)


def riesz_loss(df: DataFrame, f: str, treatment: str = "s") -> DataFrame:
    """``mean(S f^2 - 2 f)`` and the normal equation ``mean(S f) = 1`` it implies for the intercept."""
    s = F.col(treatment).cast("double")
    return df.agg(F.avg(s * F.col(f) ** 2 - 2 * F.col(f)).alias("loss"), F.avg(s * F.col(f)).alias("mean_sf"))
