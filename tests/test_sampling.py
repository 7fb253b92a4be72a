import pytest
from pyspark.sql import functions as F

from counterpoise.operators import resample, splits, synthetic


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(5_001).withColumnRenamed("id", "unit_id")


def test_split_shares_and_disjointness(ids):
    report = {r["split"]: r for r in splits.split_report(splits.assign_split(ids)).collect()}
    assert sum(r["rows"] for r in report.values()) == 5_001
    for name, share in splits.SPLIT_SHARES.items():
        assert abs(report[name]["share"] - share) < 3 * (share * (1 - share) / 5_001) ** 0.5


def test_split_does_not_depend_on_layout(ids):
    a = splits.assign_split(ids.repartition(3))
    b = splits.assign_split(ids.repartition(17, "unit_id"))
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("buckets", [1, 13])
def test_shuffled_rank_is_a_permutation(ids, monkeypatch, buckets):
    monkeypatch.setattr(splits, "_BUCKET_ROWS", max(1, 5_001 // buckets))
    ranked = splits.shuffled_rank(ids)
    assert ranked.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()[:] == (1, 5_001, 5_001)
    ordered = [r["unit_id"] for r in splits.shuffled(ids).collect()]
    assert [r["unit_id"] for r in ranked.orderBy("rn").collect()] == ordered


def test_exact_halves_chunks_and_samples(ids):
    halves = {r["fold"]: r["count"] for r in splits.exact_halves(ids).groupBy("fold").count().collect()}
    assert halves == {0: 2_500, 1: 2_501}
    chunks = {r["chunk"]: r["count"] for r in splits.assign_chunk(ids, 4).groupBy("chunk").count().collect()}
    assert chunks == {0: 1_250, 1: 1_250, 2: 1_250, 3: 1_251}
    small, large = splits.sample_n(ids, 300), splits.sample_n(ids, 300, top_rows=10)
    assert small.count() == 300 and small.exceptAll(large).count() == 0
    assert splits.sample_n(ids, 9_999).count() == 5_001


def test_equal_size(ids):
    sided = ids.withColumn("side", F.when(F.col("unit_id") < 700, "a").otherwise("b"))
    assert {r["side"]: r["count"] for r in splits.equal_size(sided, "side").groupBy("side").count().collect()} == {"a": 700, "b": 700}


def test_treatment_is_unrelated_to_fold_and_split(ids):
    df = synthetic.draw_treatment(splits.random_fold(splits.assign_split(ids)).withColumn("p", F.lit(0.4)), "p")
    for r in df.groupBy("split", "fold").agg(F.avg("s_synthetic").alias("m"), F.count("*").alias("n")).collect():
        assert abs(r["m"] - 0.4) < 4 * (0.24 / r["n"]) ** 0.5


def test_semi_synthetic_hides_outcomes(spark):
    df = spark.createDataFrame([(i, 1, 0.5, "t", 5) for i in range(200)] + [(999, 0, 0.5, "t", 5)], "unit_id long, s int, p double, text string, rating int")
    out = synthetic.semi_synthetic(df, "p").collect()
    assert len(out) == 200
    assert all((r["text"], r["rating"]) == (("t", 5) if r["s_synthetic"] else ("(missing)", -1)) for r in out)


def test_resampling_frequencies_follow_weights(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)] + [(40, 100.0)], "unit_id long, w double")
    counts = {r["unit_id"]: r["draws"] for r in resample.draw_counts(resample.weighted_resample(df, "w", 20_000)).collect()}
    total = sum(i % 4 for i in range(40)) + 100.0
    assert sum(counts.values()) == 20_000
    assert all(i % 4 for i in counts if i < 40)
    for i, n in counts.items():
        p = (100.0 if i == 40 else i % 4) / total
        assert abs(n - 20_000 * p) < 5 * (20_000 * p * (1 - p)) ** 0.5 + 1


def test_draws_are_independent_of_the_interval_layout(spark):
    """With equal weights and as many draws as units about 1/e of the units stay undrawn."""
    df = spark.range(20_000).select(F.col("id").alias("unit_id"), F.lit(1.0).alias("w"))
    summary = resample.resample_summary(resample.weighted_resample(df, "w", 20_000)).first()
    assert abs(summary["unique_units"] / 20_000 - 0.632) < 0.02 and summary["max_draws"] >= 5


@pytest.mark.parametrize("weights", [[0.0, 0.0], [float("nan"), -1.0]])
def test_all_unusable_weights_fall_back_to_uniform(spark, weights):
    df = spark.createDataFrame(list(enumerate(weights)), "unit_id long, w double")
    assert [r["x"] for r in resample.sanitized(df, "w", "x").collect()] == [1.0, 1.0]


def test_tiny_weights_keep_their_share(spark):
    df = spark.createDataFrame([(i, 1e-15 * (1 + i)) for i in range(3)], "unit_id long, w double")
    rows = resample.cumulative_intervals(df, "w").collect()
    assert sorted(round(r["hi"] - r["lo"], 9) for r in rows) == [round(x / 6, 9) for x in (1, 2, 3)]


def test_weight_quality(spark):
    df = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), float("-inf"), -1.0, 2.0)], "w double")
    assert resample.weight_quality(df, "w").first().asDict() == {"rows": 5, "negative": 2, "nan": 1, "infinite": 2}
