"""Boosted trees against plain sums, and the search that stops early."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from counterpoise.operators import boosting, propensity


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 1500)
    z = rng.normal(size=1500)
    s = rng.uniform(size=1500) < np.where(x > 2, 0.7, 0.3)
    data = [(i, float(a), float(b), int(t), i % 2, i % 5 == 0) for i, (a, b, t) in enumerate(zip(x, z, s))]
    return spark.createDataFrame(data, "unit_id long, x double, z double, s int, fold int, held boolean").cache()


def test_one_tree_gives_the_closed_form(rows):
    model = boosting.fit_inverse(rows, ["x"], depth=6, rate=1.0, trees=1, min_rows=1)
    want = {r.x: r.f for r in rows.groupBy("x").agg((F.count("*") / F.sum("s")).alias("f")).collect()}
    got = {r.x: r.f for r in model.score(rows.select("x").distinct()).collect()}
    assert got == pytest.approx(want)


def test_tree_equals_plain_greedy_splits(rows):
    found = boosting.search(rows, ["x", "z"], [boosting.Candidate(depth=2, rate=1.0, trees=1, min_rows=30)], loss="logistic", max_bins=16)
    tree, binning = found.models[0].trees[0], found.models[0].binning
    data = rows.toPandas()
    bins, s = binning.bins(data[["x", "z"]].to_numpy()), data["s"].to_numpy()
    n1, n = s.sum(), len(s)
    g, h = (n1 + 0.5) / (n + 1) - s, np.full(n, (n1 + 0.5) / (n + 1) * (n - n1 + 0.5) / (n + 1))

    def grow(node, inside, level):
        assert tree.value[node] == pytest.approx(-g[inside].sum() / h[inside].sum())
        gain, split = 0.0, None
        for j in range(2):
            for cut in range(len(binning.cuts[j])):
                low = inside & (bins[:, j] <= cut)
                high = inside & ~low
                if min(low.sum(), high.sum()) >= 30:
                    own = sum(g[m].sum() ** 2 / h[m].sum() for m in (low, high)) - g[inside].sum() ** 2 / h[inside].sum()
                    if own > gain * (1 + 1e-9):
                        gain, split = own, (j, cut, low, high)
        assert (tree.feature[node], tree.cut[node]) == (split[0], split[1])
        if level < 1:
            grow(2 * node + 1, split[2], level + 1)
            grow(2 * node + 2, split[3], level + 1)

    grow(0, np.ones(n, dtype=bool), 0)


def test_early_stopping_keeps_fewer_trees(spark, rows):
    """Trees on noise get worse on rows they do not see."""
    noise = rows.withColumn("x", F.rand(3)).withColumn("s", (F.rand(4) < 0.5).cast("int"))
    noise = spark.createDataFrame(noise.collect(), noise.schema)
    grid = [boosting.Candidate(depth=4, rate=0.5, trees=30, min_rows=5), boosting.Candidate(depth=1, rate=0.01, trees=12)]
    found = boosting.search(noise, ["x", "z"], grid, loss="inverse", validation="held", patience=4)
    assert found.statuses[0] == "stopped" and len(found.models[0].trees) + 4 == found.grown[0] < 30
    held = noise.where("held")
    losses = []
    for model in (found.models[0], boosting.Ensemble("inverse", found.models[0].binning, found.models[0].start, ())):
        data = held.toPandas()
        f = model.scores(data[["x", "z"]].to_numpy())
        losses.append(float((data["s"] * f * f - 2 * f).mean()))
    assert losses[0] == pytest.approx(found.losses[0]) and losses[0] <= losses[1]


def test_halving_keeps_the_better_half_of_each_part(rows):
    grid = [boosting.Candidate(depth=2, rate=r, trees=12, part=p) for p in (0, 1) for r in (0.001, 0.3, 0.002, 0.2)]
    found = boosting.search(rows, ["x", "z"], grid, validation="held", part="fold", halve_at=(3, 6), patience=12)
    for p in (0, 4):
        assert found.statuses[p] == found.statuses[p + 2] == "halved" and found.grown[p] == found.grown[p + 2] == 3
        assert {found.statuses[p + 1], found.statuses[p + 3]} == {"finished", "halved"}
    assert found.best(1) in found.models[4:]
    table = found.table(rows).collect()
    assert [r.part for r in table] == [0] * 4 + [1] * 4 and all(r.trees <= r.grown <= 12 for r in table)


def test_written_scores_change_nothing(rows, monkeypatch):
    grid = [boosting.Candidate(depth=2, rate=0.2, trees=7)]
    whole = boosting.search(rows, ["x", "z"], grid, validation="held")
    monkeypatch.setattr(boosting, "_REFRESH", 2)
    often = boosting.search(rows, ["x", "z"], grid, validation="held")
    assert often.losses == pytest.approx(whole.losses) and len(often.models[0].trees) == len(whole.models[0].trees)
    data = rows.toPandas()[["x", "z"]].to_numpy()
    assert np.allclose(often.models[0].scores(data), whole.models[0].scores(data))


def test_crossfit_uses_the_other_fold(rows):
    out = boosting.crossfit_inverse(rows, ["x"], depth=6, rate=1.0, trees=1, min_rows=1)
    assert out.columns == [*rows.columns, "f"] and out.count() == 1500
    want = {(1 - r.fold, r.x): r.f for r in rows.groupBy("fold", "x").agg((F.count("*") / F.sum("s")).alias("f")).collect()}
    assert {(r.fold, r.x): r.f for r in out.select("fold", "x", "f").distinct().collect()} == pytest.approx(want)


def test_odd_rows(spark, rows):
    odd = spark.createDataFrame([(1, None, float("nan"), None, None, None), (2, 1.0, 2.0, 1, 0, True)], rows.schema)
    model = boosting.fit_inverse(rows.union(odd), ["x", "z"], depth=2, trees=2, validation="held")
    assert all(r.f >= 1 and math.isfinite(r.f) for r in model.score(odd).collect())
    assert boosting.fit_inverse(rows.limit(0), ["x"], trees=3).trees == ()
    one = boosting.fit_inverse(rows.where("s = 0"), ["x"], depth=2, trees=2)
    assert one.score(rows).where("f is null").count() == 0


def test_passes_read_rows_alike_once(rows, monkeypatch):
    """The trees of a table and of three copies of it, whose passes are no longer."""
    read, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda table, *a: read.append(table.count()) or level(table, *a))
    found = [
        boosting.search(df, ["x"], [boosting.Candidate(depth=2, rate=0.3, trees=3, min_rows=30 * n)], loss="inverse", validation="held")
        for n, df in ((1, rows), (3, rows.union(rows).union(rows)))
    ]
    assert set(read) == {6 * 2 * 2}
    assert found[0].losses == pytest.approx(found[1].losses) and found[0].models[0].start == pytest.approx(found[1].models[0].start)
    for a, b in zip(found[0].models[0].trees, found[1].models[0].trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value)


def test_boosted_propensity_is_the_librarys_without_draws(rows):
    data = rows.withColumns({"x": F.col("x").cast("double"), "w": F.floor(F.col("z") * 3).cast("double")})
    settings = {"trees": 12, "depth": 3, "min_rows": 25}
    got = propensity.score(propensity.fit_boosted(data, ["x", "w"], row_share=1.0, feature_share=1.0, **settings), data)
    vectors = VectorAssembler(inputCols=["x", "w"], outputCol="v").transform(data.withColumn("s", F.col("s").cast("double")))
    library = GBTClassifier(featuresCol="v", labelCol="s", maxIter=12, stepSize=0.1, maxDepth=3, maxBins=64, minInstancesPerNode=25, subsamplingRate=1.0)
    want = library.fit(vectors).transform(vectors).select("unit_id", vector_to_array("probability")[1].alias("want"))
    assert got.join(want, "unit_id").where(F.abs(F.col("p") - F.col("want")) < 1e-9).count() == rows.count()


def test_boosted_propensity_reads_rows_alike_once(rows, monkeypatch):
    read, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda table, *a: read.append(table.count()) or level(table, *a))
    for n in (1, 4):
        data = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", F.floor("z"))
        scored = propensity.crossfit_boosted(data, ["x", "w"], trees=2, depth=2, min_rows=5 * n, treated="s")
        assert scored.count() == n * rows.where("s = 1").count() and scored.where("p <= 0 OR p >= 1").count() == 0
    assert len(read) == 10 and len(set(read)) == 1 and read[0] < rows.count() / 2
    with pytest.raises(ValueError):
        propensity.crossfit_boosted(rows.where("fold = 0"), ["x"], trees=2)
    holes = rows.withColumn("x", F.when(F.col("unit_id") % 10 > 0, F.col("x")))
    assert propensity.score(propensity.fit_boosted(holes, ["x"], trees=2), holes).count() == rows.count() * 9 // 10


def test_draws_are_binomial_and_depend_on_stack_and_tree_alone():
    stacks = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 40_000)
    for n in (1, 2, 13, 1000, 5_000_000):
        drawn = boosting._drawn(stacks, np.full(len(stacks), n), 0.8, 7)
        assert drawn.min() >= 0 and drawn.max() <= n
        assert drawn.mean() == pytest.approx(0.8 * n, abs=4 * math.sqrt(0.16 * n / len(stacks)))
        assert drawn.var() == pytest.approx(0.16 * n, rel=0.05)
        assert (boosting._drawn(stacks[::-1], np.full(len(stacks), n), 0.8, 7) == drawn[::-1]).all()
        other = boosting._drawn(stacks, np.full(len(stacks), n), 0.8, 8)
        assert abs(np.corrcoef(drawn, other)[0, 1]) < 0.02
    assert len(boosting._drawn(stacks[:0], stacks[:0], 0.8, 7)) == 0


def test_a_small_binned_table_is_held_and_gives_the_trees_of_the_passes(spark, rows, monkeypatch):
    grid = [boosting.Candidate(depth=3, rate=0.2, trees=8, part=p, row_share=share, feature_share=0.5) for p in (0, 1, None) for share in (1.0, 0.8)]
    settings = {"loss": "deviance", "validation": "held", "part": "fold", "patience": 3, "max_bins": 16}
    held = boosting.search(rows, ["x", "z"], grid, **settings)
    monkeypatch.setattr(boosting, "_HELD_BYTES", 0)
    monkeypatch.setattr(boosting, "_TASK_ROWS", 50)
    passes = boosting.search(rows, ["x", "z"], grid, **settings)
    assert held.statuses == passes.statuses and held.grown == passes.grown and held.losses == pytest.approx(passes.losses)
    for a, b in zip(held.models, passes.models):
        assert len(a.trees) == len(b.trees)
        for x, y in zip(a.trees, b.trees):
            assert (x.feature == y.feature).all() and (x.cut == y.cut).all() and x.value == pytest.approx(y.value)


def test_jobs_do_not_grow_with_the_trees(spark, rows):
    """Starting two jobs for each level of each tree took longer than the work."""
    counts = []
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"boosting-{trees}", "")
        boosting.search(rows, ["x", "z"], [boosting.Candidate(depth=2, trees=trees)])
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting-{trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] > 0
