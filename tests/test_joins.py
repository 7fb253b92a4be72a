import pytest
from pyspark.sql import functions as F

from counterpoise.operators import lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    return spark.range(9_000).select(
        F.col("id").alias("unit_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("key")
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), ("k6", 4), ("absent", 5)], "key string, v int")
    got = lookup.salted_join(skewed, right, ["key"], "unit_id", how, rows_per_task=400)
    want = skewed.join(right, ["key"], how)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_hot_rows_are_spread_over_salts(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "key string, v int")
    assert [r["key"] for r in lookup.hot_keys(skewed, ["key"], 400).collect()] == ["hot"]
    joined = lookup.salted_join(skewed, right, ["key"], "unit_id", "inner", rows_per_task=400)
    assert joined.count() == 3_000


def test_salts_follow_the_rows_and_null_keys_are_spread(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("unit_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 111 == 1, "warm").when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
    )
    hot = {r["key"]: r["_salts"] for r in lookup.hot_keys(df, ["key"], 100).collect()}
    # Under a hundredth of the rows and still hot; the number of tasks follows the rows.
    assert hot == {"warm": 2, "hot": 65}
    right = spark.createDataFrame([("hot", 1), ("warm", 2), ("warm", 3), (None, 4)], "key string, v int")
    for how in ("left", "inner"):
        got, want = lookup.salted_join(df, right, ["key"], "unit_id", how, rows_per_task=100), df.join(right, ["key"], how)
        assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_lookup_default(spark, skewed):
    dictionary = spark.createDataFrame([("hot", "A")], "key string, category string")
    counts = {r["category"]: r["count"] for r in lookup.lookup_category(skewed, dictionary, "key", "unit_id").groupBy("category").count().collect()}
    assert counts == {"A": 3_000, "Unknown": 6_000}


def test_only_open_rows_are_shuffled_to_the_tail(spark, skewed):
    table = skewed.groupBy("key").count().withColumnRenamed("count", "n").where("key is not null").withColumn("v", F.length("key"))
    plan = lookup.frequent_first_lookup(skewed, table, "key", "n", "unit_id", head_rows=2)._jdf.queryExecution().optimizedPlan().toString()
    # The tail of the table, and the rows that go there, are both without the head.
    assert plan.count("LeftAnti") == 2


@pytest.mark.parametrize("head", [1, 3, 10_000])
def test_frequent_first_lookup_equals_plain_join(spark, skewed, head):
    table = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key <> 'k7'").withColumn("v", F.length("key") + F.col("n"))
    got = lookup.frequent_first_lookup(skewed, table, "key", "n", "unit_id", head_rows=head)
    want = skewed.join(table.drop("n"), "key", "left")
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_most_frequent_prefilter_keeps_the_order(spark):
    counts = spark.range(5_000).select(F.concat(F.lit("w"), F.col("id")).alias("token"), (F.col("id") % 50).alias("n"))
    got = [tuple(r) for r in lookup.most_frequent(counts, "token", "n", 120).collect()]
    want = [tuple(r) for r in counts.orderBy(F.col("n").desc(), "token").limit(120).collect()]
    assert got == want


def test_merge_and_defaults(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "unit_id int, a double")
    b = spark.createDataFrame([(2, 3.0), (3, 4.0)], "unit_id int, b double")
    merged = lookup.merge_weight_tables([a, b], "unit_id")
    assert sorted(map(tuple, merged.collect())) == [(1, 1.0, None), (2, 2.0, 3.0), (3, None, 4.0)]
    units = spark.createDataFrame([(1, 9.0), (4, 8.0)], "unit_id int, ipw double")
    out = lookup.with_weights(units, merged, "unit_id", {"a": 0.0, "b": "ipw"})
    assert sorted((r["unit_id"], r["a"], r["b"]) for r in out.collect()) == [(1, 1.0, 9.0), (4, 0.0, 8.0)]


def test_a_key_twice_in_one_weight_table_fails(spark):
    once = spark.createDataFrame([(1, 0.5), (2, 0.25)], "unit_id long, w_a double")
    twice = spark.createDataFrame([(1, 0.5), (1, 0.75)], "unit_id long, w_b double")
    with pytest.raises(Exception, match="unit_id comes twice"):
        lookup.merge_weight_tables([once, twice], "unit_id").collect()
