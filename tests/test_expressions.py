import math

import pytest
from pyspark.sql import functions as F

from counterpoise.functions import features as fx
from counterpoise.functions import numeric as nx
from counterpoise.functions.hashing import keyed_uniform
from counterpoise.operators import columns as cx


def one(spark, column, schema, row):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,want", [(None, 0), ([], 0), (["ab"], 2), (["ab", None, "c"], 4)])
def test_joined_length_skips_nulls(spark, value, want):
    assert one(spark, fx.joined_length("a"), "a array<string>", (value,)) == want


@pytest.mark.parametrize("value,want", [(None, 0), ({}, 0), ({"k": "v"}, 3), ({"k": None, "m": "vv"}, 6)])
def test_map_text_length(spark, value, want):
    assert one(spark, fx.map_text_length("m"), "m map<string,string>", (value,)) == want


def test_null_lengths_and_sizes_are_zero(spark):
    assert one(spark, fx.text_length("t"), "t string", (None,)) == 0
    assert one(spark, fx.array_count("a"), "a array<string>", (None,)) == 0


@pytest.mark.parametrize("text,want", [("5 stars: x", 5), ("0 star", None), ("", None), (None, None), ("² stars", None), ("6", None)])
def test_rating_from_text(spark, text, want):
    assert one(spark, fx.rating_from_text("t"), "t string", (text,)) == want


@pytest.mark.parametrize("rating,text,want", [(1.0, "a", "1 star: a"), (4.9, "b", "4 stars: b"), (2.0, None, None)])
def test_star_prefix(spark, rating, text, want):
    assert one(spark, fx.star_prefixed("r", "t"), "r float, t string", (rating, text)) == want


def test_names_agree_between_python_and_columns(spark):
    label = "Arts, Crafts & Men's Pre-K and More"
    assert fx.normalize_name(label) == one(spark, fx.normalized("t"), "t string", (label,)) == "arts_crafts_and_mens_pre_k_and_more"


def test_flags_and_clipping_keep_null_rules(spark):
    assert one(spark, fx.flag_label("f"), "f boolean", (None,)) == 0.0
    assert one(spark, nx.clipped("p", 0.1, 0.9), "p double", (None,)) is None
    assert one(spark, nx.clipped("p", 0.1, 0.9), "p double", (0.0,)) == 0.1


def test_shifted_probability(spark):
    got = one(spark, nx.shifted_probability("p"), "p double", (0.97,))
    assert got == pytest.approx(1 / (1 + math.exp(8.5 - 2 * math.log(0.97 / 0.03))))


@pytest.mark.parametrize("w,want", [(float("nan"), 0), (float("inf"), 0), (float("-inf"), 0), (-1.0, 0), (None, 0), (2.5, 2.5)])
def test_usable_weight(spark, w, want):
    assert one(spark, nx.usable_weight("w"), "w double", (w,)) == want


def test_uniforms_of_two_purposes_are_unrelated(spark):
    df = spark.range(20_000).select(keyed_uniform("id", "a").alias("a"), keyed_uniform("id", "b").alias("b"))
    row = df.agg(F.corr("a", "b"), F.avg("a"), F.min("a"), F.max("a")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 0.5) < 0.01 and row[2] >= 0 and row[3] < 1


def test_invalid_ratings_are_counted(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "rating float")
    assert cx.invalid_rating_count(df).first().asDict() == {"rows": 3, "removed": 2, "kept": 1}
    assert cx.with_valid_rating(df).count() == 1


def test_plus_minus_one_needs_both_values_and_no_null(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (-1, 1, None, 0), (1, 1, -1, -1)], "a int, b int, c int, d int")
    assert cx.plus_minus_one_columns(df) == ["a"]
    assert [r["a"] for r in cx.recode_plus_minus_one(df, ["a"]).collect()] == [1, 0, 1]


def test_unknown_category_leaves_before_encoding(spark):
    df = spark.createDataFrame([("Unknown",), ("A & B",)], "category string")
    out = cx.one_hot(df, "category", ["A & B", "Unknown", "C"])
    assert out.columns == ["category", "category_a_and_b", "category_c"]
    assert [tuple(r) for r in out.collect()] == [("A & B", 1, 0)]


def test_choose_weight(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "unit_id int, a double, b double")
    assert cx.choose_weight(df, "b", ["a", "b"]).first().asDict() == {"unit_id": 1, "weight": 3.0}
    assert cx.choose_weight(df, "naive", ["a", "b"]).first()["weight"] == 1.0
    with pytest.raises(ValueError):
        cx.choose_weight(df, "c", ["a", "b"])


def test_nonzero_weight_keeps_negative(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (2.0,)], "w double")
    assert cx.nonzero_weight(df, "w").count() == 2


def test_category_list_refuses_what_is_too_long(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "category string")
    assert cx.category_list(df) == ["a", "b"] == cx.category_list(df, most=2)
    with pytest.raises(ValueError, match="category has more than 1 values"):
        cx.category_list(df, most=1)
