"""Sums over reverse neighbours against plain loops, on every path of the search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import neighbors
from counterpoise.operators import neighbour_sums as sums
from counterpoise.operators.neighbour_sums import Specification, neighbour_sums


def specs():
    return {"all": Specification(("x", "y", "t")), "some": Specification(("x", "y"), F.col("t") == 1)}


def plain(queries, candidates, k):
    def usable(row, features):
        return row["g"] is not None and all(row[f] is not None and not np.isnan(row[f]) for f in features)

    out = {}
    for name, features, allowed in (("all", ("x", "y", "t"), lambda r: True), ("some", ("x", "y"), lambda r: r["t"] == 1)):
        for q in queries:
            if not usable(q, features):
                continue
            near = [(sum((q[f] - c[f]) ** 2 for f in features), c["unit_id"]) for c in candidates if c["g"] == q["g"] and usable(c, features) and allowed(c)]
            for _, m in sorted(near)[:k]:
                own = out.setdefault(m, {}).setdefault(name, [0.0, 0.0])
                own[0] += q["one"]
                own[1] += q["w"]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    data = []
    for i in range(900):
        x, y = (float(v) for v in rng.integers(0, 40, 2)) if i % 3 else (float(v) for v in rng.normal(size=2) * 15)
        data.append({"unit_id": i, "g": ["a", "b", "a", "a"][i % 4], "x": x, "y": y, "t": float(i % 2), "one": 1.0, "w": float(rng.normal())})
    for i in range(900, 940):
        data.append({"unit_id": i, "g": "a", "x": 3.0, "y": -0.0, "t": 1.0, "one": 1.0, "w": 0.5})
    data += [
        {"unit_id": 950, "g": "a", "x": None, "y": 0.0, "t": 1.0, "one": 1.0, "w": 1.0}, {"unit_id": 951, "g": "b", "x": 1.0, "y": float("nan"), "t": 1.0, "one": 1.0, "w": 1.0},
        {"unit_id": 952, "g": "a", "x": 1.0, "y": 2.0, "t": None, "one": 1.0, "w": 1.0}, {"unit_id": 953, "g": None, "x": 1.0, "y": 2.0, "t": 1.0, "one": 1.0, "w": 1.0},
        {"unit_id": 954, "g": "c", "x": 1.0, "y": 2.0, "t": 1.0, "one": 1.0, "w": 1.0}, {"unit_id": 955, "g": "a", "x": 1e7, "y": 2.0, "t": 1.0, "one": 1.0, "w": 1.0},
    ]
    return data


@pytest.mark.parametrize("settings", [{}, {"single_cell_rows": 60, "cell_rows": 25}, {"single_cell_rows": 60, "cell_rows": 25, "task_candidates": 150}])
def test_sums_equal_brute_force(spark, rows, settings):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "unit_id long, g string, x double, y double, t double, one double, w double")
    candidates = df.where("unit_id % 2 = 0 or unit_id % 7 = 0 or unit_id >= 900")
    chosen = {r["unit_id"] for r in candidates.select("unit_id").collect()}
    found = neighbour_sums(df, candidates, 15, specs(), ["one", "w"], block="g", **settings).collect()
    want = plain(rows, [r for r in rows if r["unit_id"] in chosen], 15)
    assert {r.unit_id for r in found} == set(want)
    for r in found:
        for name in specs():
            own = want[r.unit_id].get(name)
            assert (r[f"{name}__one"] is None) == (own is None)
            if own:
                assert [r[f"{name}__one"], r[f"{name}__w"]] == pytest.approx(own)


def test_empty_sides_and_disjoint_features(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "unit_id long, g string, x double, y double, t double, one double, w double")
    assert neighbour_sums(df, df.limit(0), 5, specs(), ["one"], block="g").count() == 0
    assert neighbour_sums(df.limit(0), df, 5, specs(), ["one"], block="g").count() == 0
    with pytest.raises(ValueError):
        neighbour_sums(df, df, 5, {"a": Specification(("x",)), "b": Specification(("y",))}, ["one"], block="g")


def test_copies_are_searched_as_one_row(spark, monkeypatch):
    """Rows alike in all but their id are one stack; equal distances between stacks and inside them go by id."""
    tables = {}
    real = sums.stage
    monkeypatch.setattr(sums, "stage", lambda df, name: tables.setdefault(name, real(df, name)))
    rows = [
        {"unit_id": i, "g": "a", "x": float(i % 7), "y": float(i % 5 // 2), "t": float(i % 2), "one": 1.0, "w": float(i % 11) - 4.5} for i in range(700)
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "unit_id long, g string, x double, y double, t double, one double, w double")
    found = {r["unit_id"]: r for r in neighbour_sums(df, df, 25, specs(), ["one", "w"], block="g").collect()}
    want = plain(rows, rows, 25)
    assert set(found) == set(want) and tables["sums-candidates"].count() == 7 * 3 * 2
    for i, own in want.items():
        for name in specs():
            got = None if found[i][f"{name}__one"] is None else [found[i][f"{name}__one"], found[i][f"{name}__w"]]
            assert got == (None if own.get(name) is None else pytest.approx(own[name]))


def test_pieces_leave_out_what_is_far():
    """In two dimensions a query looks at a small part of the candidates, with the same neighbours."""
    rng = np.random.default_rng(4)
    q, c = rng.uniform(size=(6_000, 2)), rng.uniform(size=(4_000, 2))
    assert sum(len(a) * len(b) for a, b in neighbors._near_parts(q, c, 20)) < 0.2 * len(q) * len(c)
    qi, ci, _, _ = neighbors._nearest(q, c, 20)
    for i in range(0, len(q), 50):
        assert list(ci[qi == i]) == list(np.argsort(((c - q[i]) ** 2).sum(axis=1), kind="stable")[:20])
