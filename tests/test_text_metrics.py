import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import metrics, reports, text

TOL = dict(abs=1e-9)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b a\nc", 1.0), (2, "b  b", 2.0), (3, "", 1.0), (4, None, 1.0), (5, "z " * 300, 0.5)]
    return spark.createDataFrame(rows, "unit_id long, text string, w double")


def test_vocabulary_and_encoding(docs):
    vocab = text.vocabulary(docs, size=3)
    assert [tuple(r) for r in vocab.orderBy("token_id").collect()] == [("z", 300, 2), ("b", 3, 3), ("a", 2, 4)]
    out = {r["unit_id"]: r for r in text.encode(docs, vocab, length=5).collect()}
    assert out[1]["input_ids"] == [4, 3, 4, 1, 0] and out[1]["attention_mask"] == [1, 1, 1, 1, 0]
    assert out[3]["input_ids"] == [0] * 5 == out[4]["input_ids"] and out[5]["input_ids"] == [2] * 5


def test_unigram_probabilities_sum_to_one(docs):
    model = text.weighted_unigrams(docs, "w")
    total, unknown = model.agg(F.sum("p"), F.first("p_unknown")).first()
    assert total + unknown == pytest.approx(1)
    assert model.filter("token = 'b'").first()["c"] == pytest.approx(5.0)


def test_bigrams(docs):
    model = {(r["previous"], r["token"]): r["p"] for r in text.weighted_bigrams(docs, "w").collect()}
    assert model[("a", "b")] == pytest.approx((1 + 1) / (2 + 4))
    assert ("c", "b") not in model


def test_uniform_model_has_perplexity_of_its_size(spark, docs):
    model = spark.createDataFrame([(t, 1, 0.25, 0.25) for t in "abcz"], "token string, n int, p double, p_unknown double")
    out = {r["unit_id"]: r for r in text.document_perplexity(docs, model).collect()}
    assert all(out[i]["perplexity"] == pytest.approx(4) for i in (1, 2, 5))
    assert all((out[i]["tokens"], out[i]["perplexity"]) == (0, None) for i in (3, 4))
    assert out[5]["tokens"] == 300


def test_length_statistics_match_numpy(spark):
    lengths = [1, 2, 2, 3, 10, 50]
    row = text.length_statistics(spark.createDataFrame([(x,) for x in lengths], "n int"), "n").first()
    assert row["median"] == np.median(lengths) and row["p95"] == pytest.approx(np.percentile(lengths, 95))
    assert row["mean"] == pytest.approx(np.mean(lengths)) and row["max"] == 50


def test_training_table_keeps_null_weights_but_not_null_text(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (2, 1, None, 1.0), (3, 0, "c", 1.0)], "unit_id long, s int, text string, w double")
    assert [tuple(r) for r in text.training_table(df, ["w"]).collect()] == [(1, "a", None)]


def test_pmf_is_zero_filled_and_survives_no_support(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 1), ("b", 0)], "g string, rating int")
    out = {(r["g"], r["rating"]): r["p"] for r in reports.rating_pmf(df, by=["g"]).collect()}
    assert out[("a", 5)] == pytest.approx(2 / 3) and out[("a", 2)] == 0 and out[("b", 1)] == 0 and len(out) == 10


def test_wasserstein(spark):
    pmf = spark.createDataFrame([("x", r, float(r == 1)) for r in range(1, 6)] + [("y", r, 0.2) for r in range(1, 6)], "weight string, rating int, p double")
    target = spark.createDataFrame([(r, 0.2) for r in range(1, 6)], "rating int, p double")
    out = {r["weight"]: r["wasserstein"] for r in metrics.wasserstein(pmf, target, ["weight"]).collect()}
    assert out["y"] == pytest.approx(0, **TOL) and out["x"] == pytest.approx(2.0)


def test_frontier_of_equal_and_disjoint_samples(spark):
    same = spark.createDataFrame([(c, s) for c in range(4) for s in (True, False)], "cluster int, in_p boolean")
    row = metrics.divergence_frontier(same, "cluster", F.col("in_p")).first()
    assert row["score"] == pytest.approx(1) and row["frontier_integral"] == pytest.approx(0, **TOL)
    apart = spark.createDataFrame([(c, c < 2) for c in range(4)], "cluster int, in_p boolean")
    row = metrics.divergence_frontier(apart, "cluster", F.col("in_p")).first()
    assert row["score"] < 0.1 and row["frontier_integral"] == pytest.approx(1.0)


def test_frechet(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) @ np.diag([1, 2, 3]) + 1
    fa, fb = (spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>") for x in (a, b))
    assert metrics.frechet(fa, fa, "v") == pytest.approx(0, abs=1e-6)
    c1, c2 = np.cov(a.T), np.cov(b.T)
    root = np.sqrt(np.linalg.eigvals(c1 @ c2).real.clip(0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * root
    assert metrics.frechet(fa, fb, "v") == pytest.approx(want)


def test_region_weighted_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 1.0, 0.0])], "e array<double>, m array<double>")
    got = df.select(metrics.region_weighted_mean("e", "m").alias("x")).first()["x"]
    assert got == pytest.approx((1 + 9 * 2 + 3) / 11)


def test_balance_table_order_and_values(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, 5.0), (0, 0.0, 5.0)], "s int, a double, b double")
    rows = reports.balance_table(df, ["b", "a"]).collect()
    assert [r["covariate"] for r in rows] == ["a", "b"] and rows[0]["difference"] == 2.0 and rows[1]["difference"] == 0.0


def test_weighted_loss(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "w double, l double")
    assert text.weighted_loss(df, "l", "w").first()[0] == pytest.approx(14 / 4)
    assert math.isfinite(text.weighted_loss(df, "l", "w").first()[0])


def test_summary_of_all_models_scores_the_texts_once(spark, small):
    from counterpoise.plans import language

    plan = language.perplexity_summary(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_documents_without_words_keep_their_row(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0), (2, "", None), (3, None, 2.0), (4, "c", None)], "unit_id long, text string, w double")
    model = text.weighted_unigrams(docs, "w")
    out = {r["unit_id"]: (r["tokens"], r["perplexity"]) for r in text.document_perplexity(docs, model).collect()}
    assert set(out) == {1, 2, 3, 4} and out[2] == out[3] == (0, None) and out[4][0] == 1
    # A null weight counts as 0, and the row's words stay known.
    assert {r["token"]: r["c"] for r in model.collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_bigrams_with_null_weights(spark):
    df = spark.createDataFrame([("a b a b", None), ("a c", 2.0), ("d", 1.0), ("", 1.0), (None, 1.0)], "text string, w double")
    got = {(r.previous, r.token): (r.c, r.p) for r in text.weighted_bigrams(df, "w").collect()}
    assert got == {("a", "b"): (0.0, 1 / 6), ("b", "a"): (0.0, 1 / 4), ("a", "c"): (2.0, 3 / 6)}


@pytest.mark.parametrize("head", [50_000, 2])
def test_backoff_bigrams_equal_a_plain_count(spark, docs, head, monkeypatch):
    """Against sums in dictionaries, also where the lookups go through a head and a tail."""
    import functools

    monkeypatch.setattr(text, "frequent_first_lookup", functools.partial(text.frequent_first_lookup, head_rows=head))
    rows = [(1, "a b a\nc a b", 1.0), (2, "b  b a", 2.0), (3, "", 1.0), (4, None, 1.0), (5, "z " * 30, 0.5), (6, "q r a b", None), (7, "b", 1.0), (8, "c z", 0.0)]
    train = spark.createDataFrame(rows, "unit_id long, text string, w double")
    scored = spark.createDataFrame([(10, "a b z new a"), (11, "new"), (12, " "), (13, None), (14, "q r r b z z z"), (15, "c z c a")], "unit_id long, text string")
    single, pair, follow = {}, {}, {}
    for _, t, w in rows:
        ws = (t or "").split()
        for x in ws:
            single[x] = single.get(x, 0) + (w or 0)
        for x, y in zip(ws, ws[1:]):
            pair[x, y] = pair.get((x, y), 0) + (w or 0)
            follow.setdefault(x, set()).add(y)
    total = sum(single.values()) + len(single) + 1
    one = lambda y: (single.get(y, 0) + 1) / total

    def p(x, y):
        if x not in follow:
            return one(y)
        big, kinds = sum(pair[x, z] for z in follow[x]), len(follow[x])
        return (pair.get((x, y), 0) + kinds * one(y)) / (big + kinds)

    model = text.backoff_bigrams(train, "w")
    for x in list(follow) + ["new"]:
        assert sum(p(x, y) for y in single) + p(x, "unseen") == pytest.approx(1)
    got = {r["unit_id"]: r for r in text.backoff_perplexity(scored, model).collect()}
    for r in scored.collect():
        ws = (r["text"] or "").split()
        logs = [math.log(p(x, y)) for x, y in zip([None] + ws, ws)]
        assert got[r["unit_id"]]["tokens"] == len(ws)
        want = math.exp(-sum(logs) / len(ws)) if ws else None
        assert got[r["unit_id"]]["perplexity"] == (pytest.approx(want) if ws else None)
    empty = text.backoff_bigrams(train.limit(0), "w")
    assert text.backoff_perplexity(scored, empty).filter("perplexity <> 1").isEmpty() and text.backoff_perplexity(scored.limit(0), model).isEmpty()
