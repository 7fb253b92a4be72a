import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import ipw, metrics, moments, propensity
from counterpoise.plans import attributes, causal, reviews
from counterpoise.plans.fixtures import units
from counterpoise.session import scratch_path, stage
from counterpoise.sources.writers import load_model, save_model

FEATURES = ["x1", "x2", "rating"]


@pytest.fixture(scope="module")
def df(spark, small):
    return stage(units(spark, small), "units")


def test_logistic_score_equations_and_saved_model(spark, df):
    model = propensity.fit_logistic(df, FEATURES)
    assert all(abs(r["gradient"]) < 1e-4 for r in propensity.score_equations(model, df).collect())
    path = scratch_path(spark, "model")
    save_model(model, path)
    a, b = propensity.score(model, df), propensity.score(load_model(path), df)
    assert a.join(b.withColumnRenamed("p", "p2").select("unit_id", "p2"), "unit_id").filter("abs(p - p2) > 1e-12").count() == 0
    ranked = [abs(r["coefficient"]) for r in propensity.coefficient_ranking(model, FEATURES).collect()]
    assert ranked == sorted(ranked, reverse=True) and len(ranked) == 3


def test_null_feature_rows_are_removed_before_counting(spark, df):
    holes = df.withColumn("x2", F.when(F.col("unit_id") % 7 != 0, F.col("x2")))
    assert propensity.complete_rows(holes, FEATURES).count() == holes.filter("x2 is not null").count()


def test_specifications():
    spec = propensity.specification(["a", "b"], ["category_x"])
    assert spec == {"right": ["a", "b", "category_x"], "wrong": ["a", "b"]}


def test_crossfit_scores_every_row_once(df):
    out = propensity.crossfit_scores(df, lambda half: propensity.fit_boosted(half, FEATURES, trees=2, depth=2))
    assert out.count() == df.count() == out.select("unit_id").distinct().count()
    assert out.filter("p <= 0 or p >= 1").count() == 0


def test_early_stopping_uses_validation_rows(df):
    marked = df.withColumn("check", F.col("unit_id") % 4 == 0)
    model = propensity.fit_boosted(marked, FEATURES, trees=8, depth=2, validation="check")
    assert 1 <= model.stages[-1].getNumTrees <= 8


def test_tuning_reports_every_setting(df):
    found = propensity.tune_boosted(df, FEATURES, depths=(1, 2), rates=(0.1, 0.5), trees=2)
    table = found.table(df).collect()
    assert {(r.max_depth, r.rate) for r in table} == {(1, 0.1), (1, 0.5), (2, 0.1), (2, 0.5)}
    assert len(found.best().trees) <= 2 and min(r.loss for r in table) == found.losses[found.models.index(found.best())]


def test_closed_form_strata_minimise_the_criterion(df):
    fitted = ipw.inverse_propensity_by_stratum(df.withColumn("fold", F.lit(0)).withColumn("g", F.col("rating")), ["g"])
    same_fold = df.withColumn("g", F.col("rating")).groupBy("g").agg((F.count("*") / F.sum("s")).alias("f"))
    scored = df.withColumn("g", F.col("rating")).join(same_fold, "g")
    best = propensity.riesz_loss(scored, "f").first()["loss"]
    for factor in (0.9, 1.1):
        assert propensity.riesz_loss(scored.withColumn("f", F.col("f") * factor), "f").first()["loss"] > best
    assert fitted.filter("f is not null").count() == 0  # the other fold is empty


def test_linear_riesz_normal_equations(df):
    b = propensity.riesz_linear(df, FEATURES)
    scored = propensity.apply_linear(df, FEATURES, b)
    assert propensity.riesz_loss(scored, "f").first()["mean_sf"] == pytest.approx(1, abs=1e-5)
    for c in FEATURES:
        lhs, rhs = scored.agg(F.avg(F.col("s") * F.col("f") * F.col(c)), F.avg(c)).first()
        assert lhs == pytest.approx(rhs, rel=1e-4)


def _dense_logit(x, y, ridge):
    """Newton steps on the whole matrix: coefficients of z-scored features, intercept first."""
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0, ddof=1)])
    b, pen = np.zeros(z.shape[1]), ridge * np.diag([0.0, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(x) + pen, z.T @ (p - y) / len(x) + pen @ b)
    return b


def test_newton_equals_dense_solution_and_library(spark, df):
    model = propensity.newton_logistic(df, FEATURES)
    rows = df.select(*[F.col(c).cast("double") for c in FEATURES], F.col("s").cast("double")).na.drop(subset=FEATURES).toPandas().fillna(0.0)
    want = _dense_logit(rows[FEATURES].to_numpy(), rows["s"].to_numpy(), 0.01)
    assert np.allclose([model.intercept, *model.coefficients], want, atol=1e-8)
    library = propensity.fit_logistic(df, FEATURES).stages[-1]
    assert np.allclose(model.coefficients, library.coefficients.toArray(), atol=1e-3)


def test_newton_far_features_constant_features_nulls_and_separated_rows(spark):
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=400), rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x))).astype(int)
    rows = [(float(a), float(c * 50 + 1.7e9), 4.0, int(b)) for a, c, b in zip(x, t, y)] + [(None, 1.7e9, 4.0, 1), (float("nan"), 1.7e9, 4.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, s int").repartition(7)
    model = propensity.newton_logistic(df, ["a", "b", "c"])
    want = _dense_logit(np.column_stack([x, t]), y, 0.01)
    assert np.allclose([model.intercept, *model.coefficients[:2]], want, atol=1e-6) and model.coefficients[2] == 0
    assert model.score(df).count() == 400
    # Separated rows: the penalty keeps the coefficients finite, halved steps keep the loss falling.
    apart = df.na.drop().withColumn("s", (F.col("a") > 0).cast("int"))
    steep = propensity.newton_logistic(apart, ["a"], ridge=1e-6)
    assert np.isfinite(steep.coefficients).all() and steep.loss < 0.02
    with pytest.raises(ValueError):
        propensity.newton_logistic(df.limit(0), ["a"])


def test_moments_merge_far_from_zero_in_rounds_and_groups(spark, monkeypatch):
    monkeypatch.setattr(moments, "FAN_IN", 3)
    x = np.random.default_rng(0).normal(size=(300, 4)) + 1e8
    rows = [(r.tolist(), float(i % 3), None if i % 50 == 49 else i % 2 == 0) for i, r in enumerate(x)]
    frame = spark.createDataFrame([*rows, (None, 1.0, True), ([1.0, None, 1.0, 1.0], 1.0, True)], "v array<double>, w double, g boolean").repartition(20)
    got = moments.moments(frame, "v")[0]
    assert got.n == 300 and np.allclose(got.covariance(), np.cov(x.T), rtol=1e-6, atol=1e-7)
    w = np.arange(300) % 3
    for tasks in (2, 5, 20):  # unmerged, one level, two levels
        again = moments.moments(frame.coalesce(tasks), "v", tasks=tasks)[0]
        assert again.n == 300 and np.allclose(again.scatter, got.scatter, rtol=1e-6, atol=1e-5)
    got = moments.moments(frame, "v", "w")[0]
    assert got.weight == w.sum() and np.allclose(got.covariance(), np.cov(x.T, fweights=w), rtol=1e-6, atol=1e-7)
    groups = moments.moments(frame, "v", by="g")
    assert {k: m.n for k, m in groups.items()} == {True: 150, False: 144}
    assert moments.moments(frame.limit(0), "v") == {}


def test_reduced_clusters_and_directions(spark):
    rng = np.random.default_rng(1)
    plane = rng.normal(size=(200, 2)) * 0.1 + np.where(np.arange(200)[:, None] % 2, 5.0, -5.0)
    x = np.column_stack([plane, rng.normal(size=200) * 1e-3])
    df = spark.createDataFrame([*[(i, r.tolist()) for i, r in enumerate(x)], (200, None)], "id int, v array<double>")
    m = moments.moments(df, "v")[0]
    assert moments.principal_components(m, 0.9).shape == (3, 1) and moments.principal_components(m, 1.0).shape == (3, 3)
    found = {r["id"]: r["cluster"] for r in metrics.assign_clusters(df, "v", 2, share=0.9, starts=3).collect()}
    assert found[200] is None and {found[i] for i in range(0, 200, 2)} != {found[i] for i in range(1, 200, 2)} and len(set(found.values())) == 3
    assert metrics.assign_clusters(df.limit(0), "v", 2, share=0.9).isEmpty()


def test_studies_run_the_operators_own_size(spark, small, monkeypatch):
    """Neighbours, vocabulary, propensities and grid are not cut down by the queries."""
    seen = {}

    def spy(module, name, stop):
        real = getattr(module, name)

        def called(*args, **kwargs):
            bound = inspect.signature(real).bind(*args, **kwargs)
            bound.apply_defaults()
            seen[name] = bound.arguments
            if stop:
                raise InterruptedError(name)
            return real(*args, **kwargs)

        monkeypatch.setattr(module, name, called)

    grid = {(r.part, r.max_depth, r.rate) for r in causal.tune_propensity(spark, small).collect()}
    assert grid == {(p, d, r) for p in (0, 1) for d in (3, 5) for r in (0.05, 0.1, 0.3)}
    spy(attributes, "attribute_weights", True)
    with pytest.raises(InterruptedError):
        attributes.attribute_resample(spark, small)
    assert seen["attribute_weights"]["k"] == 200
    spy(reviews, "training_rows", True)
    monkeypatch.setattr(reviews, "_raw", lambda *_: (None, None, None))
    monkeypatch.setattr(reviews, "review_features", lambda *_: spark.range(1).withColumn("unit_id", F.col("id")))
    monkeypatch.setattr(reviews, "scored_splits", lambda df, *_, **__: (None, df))
    monkeypatch.setattr(reviews, "semi_synthetic_reviews", lambda df: df)
    monkeypatch.setattr(reviews, "starred_reviews", lambda df: df)
    real = reviews.review_weights

    def weights(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen["review_weights"] = bound.arguments
        return args[0]

    monkeypatch.setattr(reviews, "review_weights", weights)
    monkeypatch.setattr(reviews.propensity, "fit_boosted", lambda *_, **__: "boosted")
    with pytest.raises(InterruptedError):
        reviews.review_study(spark, small)
    assert seen["review_weights"]["k"] == 200 and seen["training_rows"]["size"] == 32_000
    assert seen["review_weights"]["fit"](None, []) == "boosted"
