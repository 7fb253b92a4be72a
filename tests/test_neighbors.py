import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import neighbors as nb

SMALL_CELLS = dict(single_cell_rows=60, cell_rows=16, tile_rows=20)


def frames(spark, rng, n, dims=2, ties=False):
    x = rng.integers(0, 6, size=(n, dims)).astype(float) if ties else rng.normal(size=(n, dims))
    block = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("b", (np.arange(n) % 5).astype(str)))
    rows = [(int(i), str(b), [float(v) for v in r], bool(rng.random() < 0.4)) for i, (b, r) in enumerate(zip(block, x))]
    df = spark.createDataFrame(rows, "unit_id long, block string, v array<double>, t boolean")
    return df, df.filter("t"), rows


def brute(rows, k):
    out = {}
    for i, b, v, _ in rows:
        near = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, c, w, t in rows if t and c == b)[:k]
        out[i] = near
    return out


def edges(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["dist"], r["match_id"]))
    return out


@pytest.mark.parametrize("options", [{}, SMALL_CELLS], ids=["one-cell", "cells-and-tiles"])
@pytest.mark.parametrize("ties", [False, True], ids=["distinct", "tied"])
def test_exact_join_equals_brute_force(spark, options, ties):
    q, c, rows = frames(spark, np.random.default_rng(1), 600, ties=ties)
    got = edges(nb.knn_join(q, c, 7, block="block", features="v", **options))
    want = brute(rows, 7)
    for i, near in want.items():
        assert [j for _, j in got[i]] == [j for _, j in near]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in near])


def test_high_dimension_with_cells(spark):
    q, c, rows = frames(spark, np.random.default_rng(2), 400, dims=24)
    got = edges(nb.knn_join(q, c, 5, block="block", features="v", **SMALL_CELLS))
    assert all([j for _, j in got[i]] == [j for _, j in near] for i, near in brute(rows, 5).items())


def test_fewer_candidates_than_k_and_empty_blocks(spark):
    q = spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.0), (3, None, 0.0), (4, "a", None)], "unit_id long, block string, x double")
    c = spark.createDataFrame([(10, "a", 1.0), (11, "a", 1.0), (12, "a", 2.0), (13, None, 0.0)], "unit_id long, block string, x double")
    got = edges(nb.knn_join(q, c, 5, block="block", features=["x"]))
    assert got == {1: [(1.0, 10), (1.0, 11), (4.0, 12)]}


def test_one_vector_holding_most_rows(spark):
    df = spark.range(3_000).select(
        F.col("id").alias("unit_id"), F.lit("a").alias("block"), F.when(F.col("id") % 10 < 7, 0.0).otherwise(F.col("id") / 10.0).alias("x")
    )
    got = edges(nb.knn_join(df, df, 4, block="block", features=["x"], **SMALL_CELLS))
    zero = sorted(i for i in range(3_000) if i % 10 < 7)[:4]
    assert [j for _, j in got[0]] == zero and [j for _, j in got[2_500]] == zero and len(got) == 3_000


def test_result_does_not_depend_on_partitions(spark):
    q, c, _ = frames(spark, np.random.default_rng(3), 500)
    a = nb.knn_join(q.repartition(2), c.repartition(9), 6, block="block", features="v", **SMALL_CELLS)
    b = nb.knn_join(q.repartition(11), c.coalesce(1), 6, block="block", features="v", **SMALL_CELLS)
    assert a.exceptAll(b).count() == 0


def test_approximate_search(spark):
    q, c, _ = frames(spark, np.random.default_rng(4), 900)
    exact = nb.knn_join(q, c, 5, block="block", features="v")
    few = nb.knn_join(q, c, 5, block="block", features="v", probes=3, **SMALL_CELLS)
    every = nb.knn_join(q, c, 5, block="block", features="v", probes=10_000, **SMALL_CELLS)
    assert nb.recall_at_k(few, exact).first()["recall"] > 0.8
    assert nb.recall_at_k(every, exact).first()["recall"] == 1.0


@pytest.mark.parametrize("shift", [1e7, 1e8, 1.7e9])
def test_cells_stay_exact_far_from_the_origin(spark, shift):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(900, 2)) * 64) / 64 + shift
    rows = [(i, "a", [float(v) for v in r], bool(i % 2)) for i, r in enumerate(x)]
    q = spark.createDataFrame(rows, "unit_id long, block string, v array<double>, t boolean")
    got = edges(nb.knn_join(q, q.filter("t"), 5, block="block", features="v", **SMALL_CELLS))
    assert all([j for _, j in got[i]] == [j for _, j in near] for i, near in brute(rows, 5).items())


def test_one_probe_gives_k_neighbours_in_blocks_of_any_size(spark):
    q, c, rows = frames(spark, np.random.default_rng(12), 340)
    for k in (3, 40):
        counts = {r["query_id"]: r["n"] for r in nb.knn_join(q, c, k, block="block", features="v", probes=1).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
        assert all(counts.get(i, 0) == len(near) for i, near in brute(rows, k).items())


def test_blocks_have_more_cells_than_probes(spark):
    _, c, _ = frames(spark, np.random.default_rng(13), 4_000)
    c = c.select("block", F.col("unit_id").alias("match_id"), "v")
    big = c.groupBy("block").agg(F.count("*").alias("n"))
    cells = nb._Cells.build(c, big, True, nb.CELL_ROWS, 1, 42)
    sizes = {r["block"]: r["n"] for r in big.collect()}
    assert all(len(points) > 10 for block, (points, _, _) in cells.model.value.items()) and set(cells.model.value) == set(sizes)


def test_carried_columns_and_reverse_sums(spark):
    q, c, _ = frames(spark, np.random.default_rng(5), 300)
    out = nb.knn_join(q.withColumn("w", F.col("unit_id") * 2.0), c, 3, block="block", features="v", carry=["w"], **SMALL_CELLS)
    assert out.filter(F.col("w") != F.col("query_id") * 2).count() == 0
    sums = nb.reverse_neighbours(out, ["w"]).agg(F.sum("n_queries"), F.sum("w")).first()
    assert sums[0] == 900 and sums[1] == 3 * 2 * sum(range(300))


def test_kernel_margin_keeps_close_calls():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1, 5)) * 1e6
    c = base + rng.normal(size=(500, 5)) * 1e-3
    q = base + rng.normal(size=(40, 5)) * 1e-3
    qi, ci, rank, dist = nb._nearest(q, c, 9)
    for i in range(40):
        true = ((c - q[i]) ** 2).sum(axis=1)
        assert list(ci[qi == i]) == list(np.lexsort((np.arange(500), true))[:9])


def test_single_row_block_and_constant_feature(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 1.0), (2, "b", 3.0, 1.0), (3, "b", 7.0, 1.0)], "unit_id long, block string, x double, y double")
    out = {r["unit_id"]: (r["x_z"], r["y_z"]) for r in nb.standardize_by_block(df, "block", ["x", "y"]).collect()}
    assert out[1] == (0.0, 0.0) and out[2][1] == 0.0 and out[2][0] == pytest.approx(-out[3][0])


def _clustered(spark, n, ids="long"):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12)) * 4
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 12))
    name = str if ids == "string" else int
    rows = [(name(i), "hot" if i % 3 else "b", [float(a) for a in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"unit_id {ids}, block string, v array<double>").repartition(6)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_probes_follow_the_wanted_recall(spark, monkeypatch, ids):
    """Measured on a pilot, far fewer than half of the cells give nine tenths of the neighbours of clustered vectors."""
    seen = {}
    real = nb._Cells.probes_for

    def spy(self, *args):
        seen.update({b: (n, len(self.model.value[b][0])) for b, n in real(self, *args).items()})
        return {b: n for b, (n, _) in seen.items()}

    monkeypatch.setattr(nb._Cells, "probes_for", spy)
    df = _clustered(spark, 3_000, ids)
    exact = nb.knn_join(df, df, 10, block="block", features="v")
    found = nb.knn_join(df, df, 10, block="block", features="v", recall=0.9)
    assert nb.recall_at_k(found, exact).first()["recall"] >= 0.9
    assert set(seen) == {"hot", "b"} and all(probes < cells / 2 for probes, cells in seen.values())


def test_recall_of_one_small_pilots_and_empty_sides(spark):
    df = _clustered(spark, 600)
    exact = nb.knn_join(df, df, 5, block="block", features="v")
    # A pilot of one query says nothing of the other block, which takes the same number.
    some = nb.knn_join(df, df, 5, block="block", features="v", recall=0.9, pilot=1)
    assert some.count() == exact.count()
    assert nb.knn_join(df.limit(0), df, 5, block="block", features="v", recall=0.9).isEmpty()
    assert nb.knn_join(df, df.limit(0), 5, block="block", features="v", recall=0.9).isEmpty()
    with pytest.raises(ValueError):
        nb.knn_join(df, df, 5, block="block", features="v", recall=0.9, probes=3)


def _visited(monkeypatch, df, k):
    """Rows of the exact search, cells visited after the home cells, and cells within radius and first bound."""
    tables, balls, real, reach = [], [], nb.stage, nb._Cells.reach

    def spy(self, q, limit):
        if not balls:
            for r in q.collect():
                centers, sizes, radii = self.model.value[r["block"]]
                open_ = np.sqrt(((np.array(r["v"]) - centers) ** 2).sum(axis=1)) <= np.sqrt(r["bound"]) + radii
                balls.append(int((open_ & (sizes > 0)).sum()) - len(r["cells"]))
        return reach(self, q, limit)

    monkeypatch.setattr(nb._Cells, "reach", spy)
    monkeypatch.setattr(nb, "stage", lambda d, name: tables.append((name, real(d, name))) or tables[-1][1])
    out = nb.knn_join(df, df, k, block="block", features="v", single_cell_rows=200, cell_rows=40, tile_rows=400)
    return out, sum(t.agg(F.sum(F.size("next"))).first()[0] or 0 for name, t in tables if name == "knn-visits"), sum(balls)


def test_best_first_rounds_visit_fewer_cells(spark, monkeypatch):
    """Six tenths at most of the cells that radius and first bound leave open, with the same neighbours."""
    df = _clustered(spark, 2_000)
    out, visited, balls = _visited(monkeypatch, df, 30)
    assert edges(out) == edges(nb.knn_join(df, df, 30, block="block", features="v"))
    assert 0 < visited < 0.6 * balls


def test_no_pair_comes_twice_and_repeats_stay(spark, monkeypatch):
    """Repeated vectors over many cells and rounds of one cell each."""
    monkeypatch.setattr(nb, "ROUNDS", (1, 1, 1, None))
    q, c, rows = frames(spark, np.random.default_rng(21), 700, dims=3, ties=True)
    out = nb.knn_join(q, c, 9, block="block", features="v", **SMALL_CELLS)
    assert out.groupBy("query_id", "match_id").count().filter("count > 1").isEmpty()
    got = edges(out)
    assert all([j for _, j in got[i]] == [j for _, j in near] for i, near in brute(rows, 9).items())


def test_blocks_that_need_most_cells_are_searched_whole(spark, monkeypatch):
    """Vectors without clusters: no query is copied to cells, measured, given or exact, and the neighbours are the true ones."""
    tables, real = [], nb.stage
    monkeypatch.setattr(nb, "stage", lambda d, name: tables.append(name) or real(d, name))
    q, c, rows = frames(spark, np.random.default_rng(31), 500, dims=24)
    want = {i: [j for _, j in near] for i, near in brute(rows, 5).items()}
    for options in ({"probes": 10_000}, {"single_cell_rows": 10, "cell_rows": 8}):
        got = edges(nb.knn_join(q, c, 5, block="block", features="v", **options))
        assert {i: [j for _, j in near] for i, near in got.items()} == want
    assert "knn-cells" in tables and "knn-homes" not in tables


def test_alike_queries_are_searched_once(spark, monkeypatch):
    """Every copy of a query gets the neighbours of its vector, with its own carried columns; the search sees each vector once."""
    tables, real = [], nb.stage
    monkeypatch.setattr(nb, "stage", lambda d, name: tables.append((name, real(d, name))) or tables[-1][1])
    q, c, rows = frames(spark, np.random.default_rng(32), 600, ties=True)
    out = nb.knn_join(q.withColumn("w", F.col("unit_id") * 2.0), c, 7, block="block", features="v", carry=["w"], **SMALL_CELLS)
    assert out.columns == ["block", "query_id", "w", "match_id", "rank", "dist"] and out.filter(F.col("w") != F.col("query_id") * 2).isEmpty()
    got = edges(out)
    assert all([j for _, j in got[i]] == [j for _, j in near] for i, near in brute(rows, 7).items())
    assert dict(tables)["knn-pooled"].count() == len({(b, tuple(v)) for _, b, v, _ in rows}) < 300
