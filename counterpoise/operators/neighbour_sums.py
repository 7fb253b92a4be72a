"""Sums over reverse nearest neighbours, for several distances in one search, without an edge ever leaving its task.

Outcome weights need, for every candidate, sums over the queries that have it among their k nearest, under more than one
specification: other features, other candidates. One search answers all of them:

1. Candidates carry a bit per specification they may serve. Those alike in features and bits are one stack of their k smallest
   ids, searched as one row; a stack is taken whole or by its smallest ids. They are divided into cells by the features that all
   specifications share; in that subspace no distance is larger than in any of them.
2. Queries go to the cell of their nearest centre. For a whole cell of queries the triangle inequality says how far the k-th
   neighbour of any of them can be, and so which candidate cells matter; features outside the shared ones widen that radius
   by their range. Only cells are compared here, no rows.
3. A task gets one cell's queries and all candidate cells they need, so its neighbours are final. It sums up per candidate
   what the queries bring, and passes on one row per candidate and specification instead of k rows per query.

A group of queries that would need more than ``TASK_CANDIDATES`` rows, as in many dimensions, is searched by ``knn_join``
instead, whose tasks hold tiles; the sums are the same. Ties go to the smaller candidate id.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterpoise.functions.hashing import salt
from counterpoise.operators import neighbors
from counterpoise.operators.neighbors import _MAX_TASKS, _TASK_PAIRS, _Cells, _assign, _ddl, _matrix, _nearest_stacks
from counterpoise.session import stage

TASK_CANDIDATES = 1 << 17
_QUERIES = 8_192


@dataclass(frozen=True)
class Specification:
    """Features of one distance, and the candidates it may choose (all when None)."""

    features: tuple[str, ...]
    candidates: Column | None = None


def _value(c: str) -> Column:
    # Adding 0.0 turns -0.0 into 0.0; what is missing serves no specification that reads it.
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) + F.lit(0.0)


def _bits(specs: Sequence[Specification], candidates: bool) -> Column:
    out = F.lit(0)
    for i, spec in enumerate(specs):
        good = F.lit(True)
        for c in spec.features:
            good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        if candidates and spec.candidates is not None:
            good = good & F.coalesce(spec.candidates, F.lit(False))
        out = out + F.when(good, 1 << i).otherwise(0)
    return out


def _load() -> Column:
    """Rows that stacks count for in a task: their ids come along, so a stack of many weighs more than one row."""
    return F.greatest(F.count("*"), F.ceil(F.sum(F.size("ids")) / 16))


def _has(i: int) -> Column:
    return F.col("bits").bitwiseAND(F.lit(1 << i)) != 0


def neighbour_sums(
    queries: DataFrame, candidates: DataFrame, k: int, specifications: Mapping[str, Specification], sums: Sequence[str], *, block: str,
    query_id: str = "unit_id", match_id: str = "unit_id", cell_rows: int = neighbors.CELL_ROWS, single_cell_rows: int = neighbors.SINGLE_CELL_ROWS,
    task_candidates: int = TASK_CANDIDATES, tile_rows: int = neighbors.TILE_ROWS, refine: int = 1, seed: int = 42,
) -> DataFrame:
    """``match_id`` and, per specification and query column, ``{name}__{column}``: its sum over the queries that chose the row.

    Rows that nobody chose under a specification have null there; rows chosen under none are left out. ``tile_rows`` is that of
    the tiled search.
    """
    specs = list(specifications.values())
    shared = [c for c in specs[0].features if all(c in s.features for s in specs)]
    if not shared:
        raise ValueError("the specifications share no feature")
    more = list(dict.fromkeys(c for s in specs for c in s.features if c not in shared))
    places = [[(shared + more).index(c) for c in s.features] for s in specs]
    vectors = [F.array(*map(_value, shared)).alias("v"), *([F.array(*map(_value, more)).alias("x")] if more else [])]
    some = (F.col("bits") > 0) & F.col("block").isNotNull()
    q = queries.select(F.col(block).alias("block"), F.col(query_id).alias("query_id"), *vectors, _bits(specs, False).alias("bits"), *sums).where(some)
    c = candidates.select(F.col(block).alias("block"), F.col(match_id).alias("match_id"), *vectors, _bits(specs, True).alias("bits")).where(some)
    # Of rows alike in everything that counts only the k smallest ids can be chosen; they are one stack, searched as one row.
    alike = ["block", "v", *(["x"] if more else []), "bits"]
    copies = F.row_number().over(W.partitionBy(*alike).orderBy("match_id"))
    c = c.withColumn("_copy", copies).where(F.col("_copy") <= k).groupBy(*alike).agg(F.sort_array(F.collect_list("match_id")).alias("ids"))
    c = stage(c.withColumn("match_id", F.get("ids", F.lit(0))), "sums-candidates")
    whole = max(single_cell_rows, k)
    sizes = stage(c.groupBy("block").agg(F.count("*").alias("n"), _load().alias("load")), "sums-blocks")
    cells = _Cells.build(c, sizes.where(F.col("n") > whole), False, cell_rows, refine, seed)
    c = cells.candidates
    q = stage(_assign(q, {b: model[0] for b, model in cells.model.value.items()}), "sums-queries")
    groups = q.groupBy("block", "cell").agg(F.count("*").alias("n"), F.max("to_center").alias("radius"))
    groups = stage(_needs(groups.join(sizes.select("block", F.col("load").alias("held")), "block"), q, c, cells, specs, places, len(shared), more, k), "sums-groups")

    near = groups.where(F.col("rows") <= task_candidates).withColumn("salts", F.ceil(F.col("n") / _QUERIES).cast("int"))
    pairs = near.agg(F.sum(F.col("n").cast("double") * F.col("rows"))).first()[0] or 0.0
    floor = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(floor, min(math.ceil(pairs / _TASK_PAIRS), _MAX_TASKS))
    keys = ["block", "home", "salt"]
    asked = q.join(near.select("block", "cell", "salts"), ["block", "cell"]).withColumns({"home": F.col("cell"), "salt": salt("query_id", F.col("salts"))})
    held = near.select("block", F.col("cell").alias("home"), "salts", F.explode("needs").alias("cell"))
    held = c.join(held, ["block", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked, held = (df.drop("cell", "to_center", "salts").repartition(tasks, *keys) for df in (asked, held))

    kind = c.schema["match_id"].dataType.simpleString()
    names = list(sums)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["ids"].combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.array([], ids.type)
        ids, sizes = ids.flatten(), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.empty(len(ids), dtype=np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        starts = np.cumsum(sizes) - sizes
        a, b = (np.column_stack([_matrix(t["v"]), *([_matrix(t["x"])] if more else [])]) if t.num_rows else np.zeros((0, len(shared + more))) for t in (left, right))
        a_bits, b_bits = left["bits"].to_numpy(), right["bits"].to_numpy()
        brought = np.column_stack([left[s].to_numpy() for s in names]) if names else np.zeros((left.num_rows, 0))
        parts = []
        for i, columns in enumerate(places):
            own_a, own_b = np.flatnonzero(a_bits >> i & 1), np.flatnonzero(b_bits >> i & 1)
            held = sizes[own_b]
            offsets = np.append(0, np.cumsum(held))
            members = np.arange(offsets[-1]) + np.repeat(starts[own_b] - offsets[:-1], held)
            (qi, ci), (pi, mi) = _nearest_stacks(a[own_a][:, columns], b[own_b][:, columns], k, offsets, order[members])

            def spread(one: np.ndarray | None) -> np.ndarray:
                whole, some = (None, None) if one is None else (one[own_a[qi]], one[own_a[pi]])
                return np.repeat(np.bincount(ci, whole, len(own_b)), held) + np.bincount(mi, some, len(members))

            rows = np.flatnonzero(spread(None))
            totals = [spread(brought[:, j]) for j in range(len(names))]
            out = pa.table({"match_id": ids.take(pa.array(members[rows])), "spec": pa.array(np.full(len(rows), i, np.int32))})
            for name, total in zip(names, totals):
                out = out.append_column(name, pa.array(total[rows]))
            parts.append(out)
        return pa.concat_tables(parts)

    schema = ", ".join([f"match_id {kind}", "spec int", *[f"`{s}` double" for s in names]])
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(summed, schema)
    far = stage(groups.where(F.col("rows") > task_candidates).select("block", "cell"), "sums-far")
    if not far.isEmpty():
        found = found.unionByName(_far(q.join(far, ["block", "cell"], "left_semi"), c, k, specs, places, len(shared), names, tile_rows))
    picked = [F.sum(F.when(F.col("spec") == i, F.col(s))).alias(f"{name}__{s}") for i, name in enumerate(specifications) for s in names]
    return found.groupBy("match_id").agg(*picked).withColumnRenamed("match_id", match_id)


def _needs(
    groups: DataFrame, q: DataFrame, c: DataFrame, cells: _Cells, specs: Sequence[Specification], places: list[list[int]], shared: int, more: list[str], k: int,
) -> DataFrame:
    """Adds ``needs``, the candidate cells that may hold a neighbour of one of the group's queries, and their ``rows``."""
    summary = c.where(F.col("block").isin(list(cells.model.value))) if len(cells.model.value) < 1000 else c
    summary = summary.groupBy("block", "cell").agg(
        _load().alias("load"), *[F.sum(F.when(_has(i), F.size("ids")).otherwise(0)).alias(f"n{i}") for i in range(len(specs))]
    ).toArrow()
    serving = {b: np.zeros((len(model[0]), len(specs)), dtype=np.int64) for b, model in cells.model.value.items()}
    loads = {b: np.zeros(len(model[0]), dtype=np.int64) for b, model in cells.model.value.items()}
    for b, cell, load, *counts in zip(*[summary[x].to_pylist() for x in summary.column_names]):
        if b in serving:
            serving[b][cell], loads[b][cell] = counts, load
    wider = np.zeros(len(more))
    if more:
        ends = [F.struct(F.min(F.get("x", F.lit(j))), F.max(F.get("x", F.lit(j)))) for j in range(len(more))]
        low_high = [np.array([tuple(e) for e in df.agg(*ends).first()], dtype=np.float64) for df in (q, c)]
        wider = np.fmax(low_high[0][:, 1], low_high[1][:, 1]) - np.fmin(low_high[0][:, 0], low_high[1][:, 0])
    # What the features outside the shared ones can add to a squared distance.
    slack = [float(sum(wider[p - shared] ** 2 for p in own if p >= shared)) for own in places]
    model = q.sparkSession.sparkContext.broadcast({b: (*m, serving[b], loads[b]) for b, m in cells.model.value.items()})

    def reach(batches):
        for batch in batches:
            needs, rows = [], []
            columns = [batch.column(x).to_pylist() for x in ("block", "cell", "radius", "held")]
            for b, home, radius, held in zip(*columns):
                if b not in model.value:
                    needs.append([0])
                    rows.append(held)
                    continue
                points, sizes, radii, counts, loads = model.value[b]
                apart = np.sqrt(((points - points[home]) ** 2).sum(axis=1))
                furthest = radius + apart + radii
                order = np.argsort(furthest, kind="stable")
                most = 0.0
                for i, extra in enumerate(slack):
                    enough = np.searchsorted(np.cumsum(counts[order, i]), min(k, counts[:, i].sum()))
                    if counts[:, i].sum() < k:
                        most = math.inf
                    else:
                        most = max(most, math.sqrt(furthest[order[enough]] ** 2 + extra))
                open_ = np.flatnonzero((apart - radii - radius <= most * (1 + 1e-9) + 1e-9 * apart) & (sizes > 0))
                needs.append(open_.tolist())
                rows.append(int(loads[open_].sum()))
            yield batch.append_column("needs", pa.array(needs, pa.list_(pa.int32()))).append_column("rows", pa.array(rows, pa.int64()))

    return groups.mapInArrow(reach, _ddl(groups) + ", needs array<int>, rows long")


def _far(q: DataFrame, c: DataFrame, k: int, specs: Sequence[Specification], places: list[list[int]], shared: int, names: list[str], tile_rows: int) -> DataFrame:
    """The same sums from the edges of the tiled search."""
    out = None
    for i, own in enumerate(places):
        vector = F.array(*[F.get("v", F.lit(p)) if p < shared else F.get("x", F.lit(p - shared)) for p in own])
        members = c.withColumn("match_id", F.explode("ids"))
        sides = [df.where(_has(i)).withColumn("vector", vector) for df in (q, members)]
        edges = neighbors.knn_join(*sides, k, block="block", features="vector", query_id="query_id", match_id="match_id", carry=names, tile_rows=tile_rows)
        part = edges.groupBy("match_id").agg(*[F.sum(s).alias(s) for s in names]).withColumn("spec", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.select("match_id", "spec", *names)
