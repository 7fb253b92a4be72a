import pytest
from pyspark.sql import functions as F

from counterpoise.operators import ipw, weights
from counterpoise.plans.fixtures import FEATURES, IPW, weighted_units
from counterpoise.session import stage


@pytest.fixture(scope="module")
def units(spark, small):
    return stage(weighted_units(spark, small), "units")


def test_stabilised_weights_average_to_one(units):
    for r in units.groupBy("fold").agg(F.avg("ipw_right").alias("a"), F.avg("ipw_wrong").alias("b")).collect():
        assert r["a"] == pytest.approx(1) and r["b"] == pytest.approx(1)
    assert units.filter("(s = 0) <> (ipw_right = 0)").count() == 0


def test_truncation_is_applied_before_the_last_scaling(spark):
    rows = [(i, 1, 0, 1e6 if i == 0 else 1.0) for i in range(4_000)] + [(i, 0, 0, 1.0) for i in range(4_000, 8_000)]
    df = spark.createDataFrame(rows, "unit_id long, s int, fold int, f double")
    out = ipw.stabilized(df, "f", truncation=50.0)
    top, mean = out.agg(F.max("ipw"), F.avg("ipw")).first()
    second = out.filter("unit_id = 1").first()["ipw"]
    raw_second = 1.0 * 2 / ((1e6 + 3_999) / 4_000)
    assert mean == pytest.approx(1) and top / second == pytest.approx(50.0 / raw_second)


@pytest.mark.parametrize("f", [0.2, None])
def test_small_or_missing_inverse_propensity_counts_as_one(spark, f):
    df = spark.createDataFrame([(1, 1, 0, f), (2, 1, 0, 3.0), (3, 0, 0, None)], "unit_id long, s int, fold int, f double")
    out = {r["unit_id"]: r["ipw"] for r in ipw.self_normalized(df, "f").collect()}
    assert out[2] / out[1] == pytest.approx(3.0) and out[3] == 0 and sum(out.values()) == pytest.approx(3)


def test_naive_weights_average_to_one(units):
    assert ipw.naive(units).agg(F.avg("naive")).first()[0] == pytest.approx(1)


@pytest.mark.parametrize("options", [{}, dict(single_cell_rows=20, cell_rows=8, tile_rows=10)], ids=["small", "cells"])
def test_totals_of_augmented_weights(units, options):
    n = units.count()
    out = weights.augmented_weights(units, 5, FEATURES, IPW, **options)
    row = out.agg(*[F.sum(c).alias(c) for c in out.columns if c.startswith(("gcomp", "aipw", "ipw"))]).first()
    assert row["gcomp_right"] == pytest.approx(n) and row["gcomp_wrong"] == pytest.approx(n)
    for a in IPW:
        for b in IPW:
            assert row[f"aipw_ipw_{a}_out_{b}"] == pytest.approx(n)
    assert out.count() == n and out.filter("s = 0 and (gcomp_right <> 0 or aipw_ipw_right_out_right <> 0)").count() == 0


def test_positive_only_never_lowers_a_weight(units):
    plain = weights.augmented_weights(units, 5, FEATURES, IPW).select("unit_id", F.col("aipw_ipw_right_out_right").alias("a"))
    kept = weights.augmented_weights(units, 5, FEATURES, IPW, positive_only=True).select("unit_id", "ipw_right", F.col("aipw_ipw_right_out_right").alias("b"))
    both = plain.join(kept, "unit_id")
    assert both.filter("b < a - 1e-9 or b < ipw_right - 1e-9").count() == 0
    assert both.filter("b > a + 1e-9").count() > 0


def test_block_without_candidates(spark):
    rows = [(i, "a", i % 2, 1, float(i), 1.0) for i in range(8)] + [(i, "b", i % 2, 0, float(i), 0.0) for i in range(8, 12)]
    df = spark.createDataFrame(rows, "unit_id long, category string, fold int, s int, x double, ipw double")
    out = {r["unit_id"]: r for r in weights.augmented_weights(df, 3, ["x"], {"right": "ipw"}).collect()}
    assert all(out[i]["gcomp_right"] == 0 and out[i]["aipw_ipw_right_out_right"] == out[i]["ipw"] for i in range(8, 12))
    assert sum(r["gcomp_right"] for r in out.values()) == pytest.approx(8)
    q, c = weights.crossfit_sides(df, "category")
    assert {r["pair_block"]: r["queries"] for r in weights.uncovered_queries(q, c).collect()} == {"b|0": 2, "b|1": 2}


def test_divisor_actual_or_fixed(spark):
    rows = [(i, "a", i % 2, 1, float(i), 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "unit_id long, category string, fold int, s int, x double, ipw double")
    q, c = weights.crossfit_sides(df, "category")
    total = lambda d: weights.neighbour_weights(q, c, 10, ["x"], ["ipw"], divisor=d).agg(F.sum("gcomp")).first()[0]
    assert total("actual") == pytest.approx(6) and total("fixed") == pytest.approx(6 * 3 / 10)


def test_shared_vectors_are_searched_once_but_counted_fully(spark):
    rows = [(i, "a", i % 2, 1 if i < 20 else 0, float(i) if i < 20 else 3.0, 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "unit_id long, category string, fold int, s int, x double, ipw double")
    q, c = weights.crossfit_sides(df, "category")
    near = weights.neighbour_weights(q, c, 2, ["x"], ["ipw"])
    assert near.agg(F.sum("gcomp")).first()[0] == pytest.approx(500)
    assert near.agg(F.sum("aug_ipw")).first()[0] == pytest.approx(250)
