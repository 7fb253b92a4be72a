"""Blocked k-nearest-neighbour joins, exact and approximate.

Plan of one join, for a block (category) of any size:

1. Candidates with the same vector are reduced to the k smallest ids. With
   ties broken by id no other copy can enter a top k, so a hot vector costs
   nothing and the result is unchanged.
2. Exact search: blocks of up to ``SINGLE_CELL_ROWS`` candidates are one cell,
   which changes the plan but not the result. Larger blocks are divided into
   Voronoi cells around sampled centres; the centres and the radius and size of
   each cell are broadcast, about ``MAX_CELLS`` of them and ``MODEL_BYTES`` at most.
   Approximate search divides every block of n candidates into about sqrt(n)
   cells, whatever its size; with ``recall`` the number of probes is measured
   on a bounded pilot of queries.
3. Exact search is best first: each query's home cells give an upper bound on
   its k-th distance, then the open cells follow in rounds of growing width
   (``ROUNDS``), nearest first, and every round tightens the bound. A cell is open
   while it may hold something nearer: by the triangle inequality on its radius,
   and by the plane halfway between its centre and the query's nearest one, which
   still excludes cells in many dimensions. Queries without an open cell drop out.
   Approximate search visits the ``probes`` nearest cells, and as many more as it
   takes to hold k candidates.
4. Visits are equi-joined on (block, cell). Cells with many candidates are cut
   into tiles and cells with many queries are salted, so a task never holds
   more than ``TILE_ROWS`` candidates and one chunk of queries. Each task keeps
   the best k per query; pairs beyond that never leave it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterpoise.functions.hashing import keyed_uniform, salt
from counterpoise.operators.lookup import attach_group_stats, salted_join
from counterpoise.session import stage

MAX_CELLS = 65_536
MODEL_BYTES = 128 << 20
SINGLE_CELL_ROWS = 8_192
CELL_ROWS = 1_024
TILE_ROWS = 8_192
# Candidates of one tile where a block is searched without cells: larger tiles mean fewer copies of every query.
SCAN_ROWS = 32_768
# Queries whose exact neighbours tell how many cells a wanted recall takes.
PILOT_QUERIES = 256
# Cells that a query visits in each round of the exact search after its home cells; the last round takes all that are open.
ROUNDS = (4, 16, 64, None)
# Elements of one distance matrix held by a task: small enough for the processor cache.
_MATRIX = 1 << 18
# Queries are searched in pieces of this many that lie together, in up to this many dimensions.
_LEAF, _FEW_DIMENSIONS = 64, 6
# Pairs of one task, and a limit on tasks that keeps the shuffle's block count sane.
_TASK_PAIRS, _MAX_TASKS = 10_000_000, 20_000


def block_statistics(df: DataFrame, block: str, features: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation per block; a null mean is 0, a null or zero deviation 1."""
    aggs = []
    for c in features:
        aggs.append(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}__mean"))
        std = F.stddev_samp(c)
        aggs.append(F.when(std > 0, std).otherwise(1.0).alias(f"{c}__std"))
    return df.groupBy(block).agg(*aggs)


def standardize_by_block(
    df: DataFrame, block: str, features: Sequence[str], stats: DataFrame | None = None, suffix: str = "_z"
) -> DataFrame:
    """Add standardised copies of the features, using the frame's own statistics unless given others."""
    own = block_statistics(df, block, features) if stats is None else stats
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in features}
    joined = attach_group_stats(df, own, [block], "block-stats")
    return joined.withColumns(scaled).drop(*[f"{c}__mean" for c in features], *[f"{c}__std" for c in features])


def knn_join(
    queries: DataFrame, candidates: DataFrame, k: int, *, block: str, features: Sequence[str] | str,
    query_id: str = "unit_id", match_id: str = "unit_id", carry: Sequence[str] = (), probes: int | None = None,
    recall: float | None = None, pilot: int = PILOT_QUERIES, refine: int = 1, seed: int = 42, cell_rows: int = CELL_ROWS, single_cell_rows: int = SINGLE_CELL_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The k nearest candidates of every query inside its block, by squared L2, ties by match id.

    Returns ``block, query_id, match_id, rank, dist`` and the ``carry``
    columns of the query. ``features`` names numeric columns or one array
    column. ``probes=None`` is exact; a number searches that many of a block's
    sqrt(n) cells per query, more where they hold fewer than k candidates. With
    ``recall`` instead, ``probes_for`` chooses that number for each block. A
    block with fewer than k candidates gives all of them. Rows with a null or NaN feature have no
    distance and take no part.
    """
    if probes is not None and recall is not None:
        raise ValueError("give either probes or recall")
    v = _vector(features)
    finite = F.col("block").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    q = queries.select(F.col(block).alias("block"), F.col(query_id).alias("query_id"), v.alias("v"), *carry).filter(finite)
    c = candidates.select(F.col(block).alias("block"), F.col(match_id).alias("match_id"), v.alias("v")).filter(finite)
    # Queries alike have the same neighbours: where they are half of all or more, each vector is searched once.
    rows, vectors = q.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("block", "v"))).first()
    settings = (probes, recall, pilot, refine, seed, cell_rows, single_cell_rows, tile_rows)
    if 2 * vectors > rows:
        return _search(q, c, k, carry, *settings)
    pooled = stage(q.groupBy("block", "v").agg(F.min("query_id").alias("query_id")), "knn-pooled")
    found = _search(pooled, c, k, (), *settings).groupBy("block", "query_id").agg(F.collect_list(F.struct("match_id", "rank", "dist")).alias("_near"))
    found = stage(pooled.join(found, ["block", "query_id"]).select("block", "v", "_near"), "knn-found-by-vector")
    joined = salted_join(q, found, ["block", "v"], "query_id", "inner")
    return joined.select("block", "query_id", *carry, F.inline("_near"))


def _search(
    q: DataFrame, c: DataFrame, k: int, carry: Sequence[str], probes: int | None, recall: float | None, pilot: int, refine: int, seed: int,
    cell_rows: int, single_cell_rows: int, tile_rows: int,
) -> DataFrame:
    """``knn_join`` of rows with finite features: q ``block, query_id, v, *carry``, c ``block, match_id, v``."""
    approximate = probes is not None or recall is not None
    same = W.partitionBy("block", "v").orderBy("match_id")
    c = stage(c.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= k).drop("_copy"), "knn-candidates")

    # Blocks up to this size are one tile of one cell, so a task's result is final.
    whole = 0 if approximate else max(single_cell_rows, k)
    big = stage(c.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole), "knn-blocks")
    chunk = min(8_192, max(256, (1 << 20) // k))
    if big.isEmpty():
        return _best(q.withColumn("cell", F.lit(0)), c.withColumn("cell", F.lit(0)), k, carry, whole, chunk)

    plain = _best(
        q.join(big, "block", "left_anti").withColumn("cell", F.lit(0)),
        c.join(big, "block", "left_anti").withColumn("cell", F.lit(0)), k, carry, whole, chunk,
    )
    wide_q, wide_c = q.join(big, "block", "left_semi"), c.join(big, "block", "left_semi")
    cells = _Cells.build(wide_c, big, approximate, cell_rows, refine, seed)
    c_cells = cells.candidates

    if recall is not None:
        probes = cells.probes_for(wide_q, k, recall, pilot, seed)
    scanned = cells.scanned(wide_q, k, probes, recall is not None, pilot, seed)
    parts = None
    if scanned:
        names = q.sparkSession.createDataFrame([(b,) for b in scanned], f"block {q.schema['block'].dataType.simpleString()}")
        sides = [df.join(names, "block", "left_semi").withColumn("cell", F.lit(0)) for df in (wide_q, c_cells.drop("to_center"))]
        parts = _best(*sides, k, carry, max(tile_rows, SCAN_ROWS), chunk)
        wide_q, c_cells = (df.join(names, "block", "left_anti") for df in (wide_q, c_cells))
        cells.candidates = c_cells
    # Blocks without centres are never scanned.
    if big.count() > len(scanned):
        homes = stage(cells.visit(wide_q, k, probes), "knn-homes")
        if approximate:
            found = _best(homes.withColumn("cell", F.explode("cells")).drop("cells"), c_cells, k, carry, tile_rows, chunk)
        else:
            found = _best_first(homes, cells, k, carry, tile_rows, chunk)
        parts = found if parts is None else parts.unionByName(found)
    nearest = W.partitionBy("block", "query_id").orderBy("dist", "match_id")
    merged = parts.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return plain.unionByName(merged)


def reverse_neighbours(edges: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """Per candidate: how many queries chose it, and sums over those queries.

    Sums, not lists, so partial aggregation leaves one row per candidate and
    task however popular a candidate is.
    """
    return edges.groupBy("block", "match_id").agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.sum(s).alias(s) for s in sums]
    )


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact edges that the approximate search found."""
    keys = ["block", "query_id", "match_id"]
    found = approximate.select(*keys, F.lit(1).alias("_found"))
    return exact.select(*keys).join(found, keys, "left").agg(
        F.count(F.lit(1)).alias("edges"), F.count("_found").alias("found"),
        (F.count("_found") / F.count(F.lit(1))).alias("recall"),
    )


def _vector(features: Sequence[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    # Adding 0.0 turns -0.0 into 0.0, so equal vectors are equal keys.
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])


def _best_first(homes: DataFrame, cells: "_Cells", k: int, carry: Sequence[str], tile_rows: int, chunk: int) -> DataFrame:
    """The exact search in rounds; every cell is visited once per query at most, so the parts hold no pair twice."""
    visits = homes.withColumn("cell", F.explode("cells")).drop("cells")
    parts = stage(_best(visits, cells.candidates, k, carry, tile_rows, chunk), "knn-found")
    state, found = homes.withColumn("dists", F.array().cast("array<double>")), parts
    for limit in ROUNDS:
        kth = found.groupBy("block", "query_id").agg(F.collect_list("dist").alias("_new"))
        # Only the k distances found so far travel with a query, not its neighbours.
        state = state.join(kth, ["block", "query_id"], "left").withColumn(
            "dists", F.slice(F.sort_array(F.concat("dists", F.coalesce("_new", F.array().cast("array<double>")))), 1, k)
        ).drop("_new")
        state = state.withColumn("bound", F.get("dists", F.lit(k - 1)))
        visits = stage(cells.reach(state, limit), "knn-visits")
        if visits.isEmpty():
            break
        asked = visits.withColumn("cell", F.explode("next")).drop("cells", "next", "more", "dists")
        found = _best(asked, cells.candidates, k, carry, tile_rows, chunk)
        state = visits.filter("more").drop("next", "more", "bound")
        if limit is None or state.isEmpty():
            return parts.unionByName(found)
        found = stage(found, "knn-found")
        parts = parts.unionByName(found)
    return parts


def _best(q: DataFrame, c: DataFrame, k: int, carry: Sequence[str], tile_rows: int, chunk: int) -> DataFrame:
    """Best k per query inside every (block, cell, tile), with queries salted into chunks.

    Input columns: q ``block, cell, query_id, v[, bound], *carry``; c ``block,
    cell, match_id, v``. A tile's result is final when its cell is the only
    one visited and has one tile.
    """
    q, c = _spread(q, c, tile_rows, chunk)
    keys = ["block", "cell", "tile", "salt"]
    fields = {f.name: f.dataType for f in q.schema.fields}
    carried = ["block", "query_id", *carry]
    match_type = c.schema["match_id"].dataType.simpleString()
    schema = ", ".join(
        [f"`{n}` {fields[n].simpleString()}" for n in carried] + [f"match_id {match_type}", "rank int", "dist double"]
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("match_id", "ascending")]))
        bound = left["bound"].to_numpy() if "bound" in left.column_names else None
        qi, ci, rank, dist = _nearest(_matrix(left["v"]), _matrix(right["v"]), k, bound)
        out = left.select(carried).take(pa.array(qi))
        out = out.append_column("match_id", right["match_id"].take(pa.array(ci)))
        return out.append_column("rank", pa.array(rank.astype(np.int32))).append_column("dist", pa.array(dist))

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, schema)


def _spread(q: DataFrame, c: DataFrame, tile_rows: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Cut crowded cells: candidates into tiles, queries into salted chunks, each copied to the other's parts."""
    key = ["block", "cell"]
    load = stage(
        c.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).join(q.groupBy(*key).agg(F.count(F.lit(1)).alias("_q")), key),
        "knn-load",
    )
    # The join is heavy in arithmetic and light in bytes, so its parallelism
    # follows the number of pairs to look at, not the shuffled volume.
    pairs = load.agg(F.sum(F.col("_c").cast("double") * F.col("_q"))).first()[0] or 0.0
    floor = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(floor, min(math.ceil(pairs / _TASK_PAIRS), _MAX_TASKS))
    load = load.select(
        *key, F.ceil(F.col("_c") / tile_rows).cast("int").alias("_tiles"),
        F.ceil(F.col("_q") / chunk).cast("int").alias("_salts"),
    ).filter((F.col("_tiles") > 1) | (F.col("_salts") > 1))
    one = F.lit(1)
    tiles, salts = F.coalesce("_tiles", one), F.coalesce("_salts", one)
    q = q.join(load, key, "left").withColumns(
        {"salt": salt("query_id", salts), "tile": F.explode(F.sequence(F.lit(0), tiles - 1))}
    )
    c = c.join(load, key, "left").withColumns(
        {"tile": salt("match_id", tiles), "salt": F.explode(F.sequence(F.lit(0), salts - 1))}
    )
    parts = ["block", "cell", "tile", "salt"]
    return (
        q.drop("_tiles", "_salts").repartition(tasks, *parts), c.drop("_tiles", "_salts").repartition(tasks, *parts)
    )


class _Cells:
    """Voronoi cells of the large blocks."""

    def __init__(self, spark, centers: dict, candidates: DataFrame, celled: DataFrame):
        self.candidates = candidates
        summary = candidates.join(celled, "block", "left_semi").groupBy("block", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("to_center").alias("radius")
        ).toArrow()
        sizes = {b: np.zeros(len(p), dtype=np.int64) for b, p in centers.items()}
        radii = {b: np.zeros(len(p)) for b, p in centers.items()}
        for b, cell, n, radius in zip(*[summary[x].to_pylist() for x in ("block", "cell", "n", "radius")]):
            if b in centers:
                sizes[b][cell], radii[b][cell] = n, radius
        self.model = spark.sparkContext.broadcast({b: (p, sizes[b], radii[b]) for b, p in centers.items()})

    @classmethod
    def build(cls, c: DataFrame, big: DataFrame, approximate: bool, cell_rows: int, refine: int, seed: int) -> "_Cells":
        spark = c.sparkSession
        total, width = c.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        # Shares of a fixed budget of centres, so what is collected and broadcast is bounded.
        budget = max(2, min(MAX_CELLS, MODEL_BYTES // (8 * (width or 1))))
        per_cell = max(cell_rows, math.ceil(total / budget))
        if approximate:
            # sqrt(n) cells a block; all blocks give way alike where that would exceed the budget.
            every = big.agg(F.sum(F.sqrt("n"))).first()[0] or 1.0
            count = F.sqrt("n") * F.lit(min(1.0, budget / every))
        else:
            count = F.least(F.ceil(F.col("n") / per_cell), F.floor(F.col("n") * F.lit(budget / max(total, 1))))
        # A block of under two cells stays one cell, cut into tiles.
        rates = stage(big.select("block", (count / F.col("n")).alias("rate")).filter(count >= 2), "knn-rates")
        sample = (
            c.join(rates, "block").filter(keyed_uniform("match_id", "center", seed) < F.col("rate")).select("block", "v").toArrow()
        )
        centers = _centers(sample["block"], _matrix(sample["v"]))
        assigned = _assign(c, centers)
        for _ in range(refine if centers else 0):
            means = (
                assigned.join(rates, "block", "left_semi").groupBy("block", "cell")
                .agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))
                .select("block", "v").toArrow()
            )
            centers = _centers(means["block"], _matrix(means["v"]), centers)
            assigned = _assign(c, centers)
        return cls(spark, centers, stage(assigned, "knn-cells"), rates)

    def probes_for(self, q: DataFrame, k: int, recall: float, pilot: int, seed: int) -> dict:
        """Per block, how many of the nearest cells hold the share ``recall`` of the true neighbours.

        ``pilot`` queries, those of the smallest hashes, are compared with every candidate: they are broadcast, a task keeps
        the k best of its own candidates for each, and only these reach the driver's merge. Of the cells that hold the true
        neighbours, counted from each query's nearest centre, comes the smallest number that covers the share, with two
        standard errors of the pilot added. Blocks that the pilot misses take the largest number of the others.
        """
        known = self.model.value
        sample = q.filter(F.col("block").isin(*known)) if len(known) <= 1_000 else q
        sample = sample.select("block", "query_id", "v").orderBy(keyed_uniform("query_id", "pilot", seed), "query_id").limit(pilot).toArrow()
        points = {b: _matrix(sample["v"].take(pa.array(rows))) for b, rows in _rows_by_block(sample["block"].combine_chunks(), known)}
        shared = q.sparkSession.sparkContext.broadcast(points)

        def run(batches):
            best, types = {}, None
            for batch in batches:
                types = batch.schema.field("block").type, batch.schema.field("match_id").type
                v, ids = _matrix(batch.column("v")), batch.column("match_id")
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
                for b, rows in _rows_by_block(batch.column("block"), shared.value):
                    qi, ci, _, dist = _nearest(shared.value[b], v[rows], k)
                    old = best.get(b)
                    new = (qi, dist, cell[rows][ci], ids.take(pa.array(rows[ci])).to_pylist())
                    if old is not None:
                        new = tuple(np.concatenate([x, y]) for x, y in zip(old[:3], new[:3])) + (old[3] + new[3],)
                    best[b] = _first_by_query(*new, k)
            for b, (qi, dist, cell, ids) in best.items():
                columns = [pa.array([b] * len(qi), types[0]), pa.array(qi), pa.array(dist), pa.array(cell), pa.array(ids, types[1])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "pilot", "dist", "cell", "match_id"])

        block = q.schema["block"].dataType.simpleString()
        match = self.candidates.schema["match_id"].dataType.simpleString()
        found = self.candidates.select("block", "match_id", "v", "cell").mapInArrow(
            run, f"block {block}, pilot long, dist double, cell int, match_id {match}"
        )
        nearest = W.partitionBy("block", "pilot").orderBy("dist", "match_id")
        true = found.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= k).groupBy("block", "pilot", "cell").count().toArrow()
        pilots, cells, counts = (true[c].to_numpy() for c in ("pilot", "cell", "count"))
        wanted = {}
        for b, rows in _rows_by_block(true["block"].combine_chunks(), known):
            d, _ = _distances(points[b], known[b][0])
            place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)[pilots[rows], cells[rows]]
            order = np.argsort(place, kind="stable")
            share = np.cumsum(counts[rows][order]) / counts[rows].sum()
            target = min(1.0, recall + 2.0 * math.sqrt(recall * (1.0 - recall) / len(points[b])))
            wanted[b] = int(place[order][np.searchsorted(share, target - 1e-12)]) + 1
        # What the pilot cannot tell is searched as widely as the widest block, or whole.
        rest = max(wanted.values(), default=None)
        return {b: wanted.get(b, rest or len(known[b][0])) for b in known}

    def scanned(self, q: DataFrame, k: int, probes: int | dict | None, measured: bool, pilot: int, seed: int) -> list:
        """Blocks that are searched without cells, because a query would be copied to most of them.

        With given probes those of no more cells than that. Where the probes were measured, and in the exact search of many
        dimensions, those where the nine tenths, or the wanted share, of a pilot's true neighbours take half of the cells.
        """
        held = {b: len(p) for b, (p, *_) in self.model.value.items()}
        if probes is None:
            if not held or next(iter(self.model.value.values()))[0].shape[1] <= _FEW_DIMENSIONS:
                return []
            probes, measured = self.probes_for(q, k, 0.9, pilot, seed), True
        most = {b: probes[b] if isinstance(probes, dict) else probes for b in held}
        return [b for b, n in held.items() if most[b] * (2 if measured else 1) >= n]

    def visit(self, q: DataFrame, k: int, probes: int | dict | None) -> DataFrame:
        """Home cells of each query: the ``probes`` nearest, or the nearest ones holding k candidates."""

        def choose(v: np.ndarray, centers: np.ndarray, sizes: np.ndarray, radii: np.ndarray, probes: int | None):
            first = min(len(centers), probes or 32)
            d, _ = _distances(v, centers)
            near = np.argpartition(d, first - 1, axis=1)[:, :first]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
            held = np.cumsum(sizes[near], axis=1)
            if (held[:, -1] < k).any():
                near = np.argsort(d, axis=1, kind="stable")
                held = np.cumsum(sizes[near], axis=1)
            counts = np.minimum((held < k).sum(axis=1) + 1, len(centers))
            if probes is not None:
                counts = np.maximum(counts, first)
            return counts, near[np.arange(near.shape[1]) < counts[:, None]]

        return self._with_cells(q, choose, lambda b: probes[b] if isinstance(probes, dict) else probes)

    def reach(self, q: DataFrame, limit: int | None) -> DataFrame:
        """Queries with open cells that are not among their ``cells``: the ``limit`` nearest of those as ``next``, added to
        ``cells``, and whether there are ``more``.

        What a cell holds is at least as far as its centre less its radius. It is also nearer to that centre than to the
        query's nearest one, so at least as far as the plane between the two. Rounding can only add visits.
        """
        model, names = self.model, q.columns

        def choose(v, bound, seen, centers, sizes, radii):
            d, error = _distances(v, centers)
            most = np.sqrt(bound)[:, None]
            near = np.sqrt(np.maximum(d * d - error, 0.0)) <= (most + radii) * (1 + 1e-12)
            # Candidates chose their cells by distances of the same kind, so the plane is known up to their error.
            spread = (np.sqrt(((centers - centers.mean(axis=0)) ** 2).sum(axis=1)) + radii).max()
            slack = 2.0 * error.max(axis=1)[:, None] + 16e-16 * (v.shape[1] + 8) * spread * spread
            home = d.argmin(axis=1)
            gap, gap_error = _distances(centers[home], centers)
            ahead = d * d - (d[np.arange(len(v)), home] ** 2)[:, None] - slack
            # Kept as a product: the nearest centre itself has no gap.
            open_ = near & (ahead <= 2.0 * np.sqrt(gap * gap + gap_error) * most * (1 + 1e-12)) & (sizes > 0)
            lengths = np.array([len(s) for s in seen])
            open_[np.repeat(np.arange(len(v)), lengths), np.concatenate(seen)] = False
            counts = open_.sum(axis=1)
            if limit is None or counts.max() <= limit:
                return counts, np.nonzero(open_)[1], np.zeros(len(v), dtype=bool)
            order = np.argsort(np.where(open_, d, np.inf), axis=1, kind="stable")[:, :limit]
            taken = np.minimum(counts, limit)
            return taken, order[np.arange(limit) < taken[:, None]], counts > limit

        def run(batches):
            for batch in batches:
                v, bound = _matrix(batch.column("v")), batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
                bound = np.where(np.isnan(bound), np.inf, bound)
                lists = batch.column("cells")
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                parts, more = [], np.zeros(batch.num_rows, dtype=bool)
                counted = np.zeros(batch.num_rows, dtype=np.int64)
                for b, rows in _rows_by_block(batch.column("block"), model.value):
                    step = max(1, _MATRIX // len(model.value[b][0]))
                    for lo in range(0, len(rows), step):
                        part = rows[lo : lo + step]
                        seen = [flat[offsets[r] : offsets[r + 1]] for r in part]
                        counts, cells, more[part] = choose(v[part], bound[part], seen, *model.value[b])
                        counted[part] = counts
                        parts.append((part, counts, cells))
                added = _ragged(batch.num_rows, parts, 0)
                yield batch.append_column("next", added).append_column("more", pa.array(more)).filter(pa.array(counted > 0))

        schema = _ddl(q) + ", next array<int>, more boolean"
        return q.mapInArrow(run, schema).select(*[n for n in names if n != "cells"], F.concat("cells", "next").alias("cells"), "next", "more")

    def _with_cells(self, q: DataFrame, choose, probes) -> DataFrame:
        """Add the chosen cells of each query; cell 0 in blocks without centres."""
        model = self.model

        def run(batches):
            for batch in batches:
                v = _matrix(batch.column("v"))
                parts = []
                for b, rows in _rows_by_block(batch.column("block"), model.value):
                    step = max(1, _MATRIX // len(model.value[b][0]))
                    for lo in range(0, len(rows), step):
                        part = rows[lo : lo + step]
                        parts.append((part, *choose(v[part], *model.value[b], probes(b))))
                yield batch.append_column("cells", _ragged(batch.num_rows, parts))

        return q.mapInArrow(run, _ddl(q) + ", cells array<int>")


def _assign(c: DataFrame, centers: dict) -> DataFrame:
    """Nearest centre of each candidate and the distance to it; cell 0 in blocks without centres."""
    model = c.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"))
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            to_center = np.zeros(batch.num_rows)
            for b, rows in _rows_by_block(batch.column("block"), model.value):
                points = model.value[b]
                step = max(1, _MATRIX // len(points))
                if v.shape[1] <= _FEW_DIMENSIONS:
                    qi, ci, _, dist = _nearest(v[rows], points, 1)
                    cell[rows[qi]], to_center[rows[qi]] = ci, np.sqrt(dist)
                    continue
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    cell[part] = _distances(v[part], points)[0].argmin(axis=1)
                    to_center[part] = np.sqrt(((v[part] - points[cell[part]]) ** 2).sum(axis=1))
            yield batch.append_column("cell", pa.array(cell)).append_column("to_center", pa.array(to_center))

    return c.mapInArrow(run, _ddl(c) + ", cell int, to_center double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Array column of equal-length rows as a dense matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances by the product form, and the largest error of their squares.

    Both sides are moved to the centre of ``b`` first: the error grows with the norms, which far from the origin would be
    many times the distances. Moving itself errs by a part of the larger coordinate only where that is far from the centre.
    """
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    an, bn = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)
    error = 4e-16 * (a.shape[1] + 8) * (an + bn)
    return np.sqrt(np.maximum(an + bn - 2.0 * (a @ b.T), 0.0)), error


def _rows_by_block(blocks: pa.Array, known: dict):
    """Row numbers of every block that has cells."""
    coded = blocks.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(coded.dictionary.to_pylist()):
        if name in known:
            yield name, np.flatnonzero(codes == code)


def _ragged(n: int, parts: list, other: int = 1) -> pa.Array:
    """Lists for n rows from (rows, list lengths, values in that order); rows not mentioned hold ``other`` zeros."""
    lengths = np.full(n, other, dtype=np.int64)
    for rows, counts, _ in parts:
        lengths[rows] = counts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = np.zeros(offsets[-1], dtype=np.int32)
    for rows, counts, cells in parts:
        inside = np.arange(len(cells)) - np.repeat(np.cumsum(counts) - counts, counts)
        values[np.repeat(offsets[rows], counts) + inside] = cells
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _centers(blocks, points: np.ndarray, known: dict | None = None) -> dict:
    """Distinct points of every block, of the known blocks only when given."""
    rows: dict = {}
    for row, b in enumerate(blocks.to_pylist()):
        if known is None or b in known:
            rows.setdefault(b, []).append(row)
    return {b: np.unique(points[r], axis=0) for b, r in rows.items()}


def _first_by_query(qi: np.ndarray, dist: np.ndarray, cell: np.ndarray, ids: list, k: int) -> tuple:
    """The k nearest rows of every query; of equal distances the smaller ids."""
    by_id = np.empty(len(ids), dtype=np.int64)
    by_id[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    order = np.lexsort((by_id, dist, qi))
    keep = order[np.arange(len(order)) - np.searchsorted(qi[order], qi[order]) < k]
    return qi[keep], dist[keep], cell[keep], [ids[i] for i in keep]


def _near_parts(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray | None = None, held: np.ndarray | None = None):
    """Pieces (rows of q, rows of c) that together hold the k nearest of every query.

    In few dimensions queries are halved along their widest side down to ``_LEAF`` rows. The k-th distance from the middle of
    a piece, widened by the piece's radius, bounds that of its queries, so what lies further from the middle by another radius
    is left out. ``held`` says how many candidates a row of c stands for. Rows of c stay in order.
    """
    pieces = [(np.arange(len(q)), np.arange(len(c)))]
    if q.shape[1] > _FEW_DIMENSIONS:
        yield from pieces
        return
    while pieces:
        a, b = pieces.pop()
        own = q[a]
        low, high = own.min(axis=0), own.max(axis=0)
        middle = low + (high - low) / 2
        radius = math.sqrt(((own - middle) ** 2).sum(axis=1).max())
        need = k if held is None else min(k, math.ceil(k / held[b].min()))
        if need < len(b):
            away = np.sqrt(((c[b] - middle) ** 2).sum(axis=1))
            most = np.partition(away, need - 1)[need - 1] + radius
            if bound is not None:
                most = min(most, math.sqrt(bound[a].max()))
            b = b[away <= (most + radius) * (1 + 1e-9)]
        if len(b) == 0:
            continue
        if len(a) <= _LEAF or len(b) <= max(need, _LEAF) or radius == 0.0:
            yield a, b
            continue
        order = np.argpartition(own[:, np.argmax(high - low)], len(a) // 2)
        pieces += [(np.sort(a[order[: len(a) // 2]]), b), (np.sort(a[order[len(a) // 2 :]]), b)]


def _shortlist(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray | None = None):
    """Per step of queries: query rows, candidate rows and distances, by query and distance, holding the k nearest and more.

    A matrix product shortlists, a margin covers its rounding error, and the shortlisted pairs get their exact distance.
    """
    m, d = c.shape
    # Moved to the candidates' centre, so that norms and with them the margin stay small far from the origin.
    centre = c.mean(axis=0)
    moved = c - centre
    cn = (moved * moved).sum(axis=1)
    # |a|^2 + |c|^2 - 2ac as one product of widened matrices.
    right = np.vstack([-2.0 * moved.T, cn, np.ones(m)])
    step = max(1, _MATRIX // m)
    for lo in range(0, len(q), step):
        a = q[lo : lo + step]
        near = a - centre
        an = (near * near).sum(axis=1)
        sq = np.column_stack([near, np.ones(len(a)), an]) @ right
        margin = 1e-15 * (d + 8) * (an + cn.max())
        cut = np.partition(sq, k - 1, axis=1)[:, k - 1] if k < m else np.full(len(a), np.inf)
        if bound is not None:
            cut = np.minimum(cut, bound[lo : lo + step] * (1 + 1e-12))
        qi, ci = np.divmod(np.flatnonzero(sq <= (cut + 2 * margin)[:, None]), m)
        dist = np.empty(len(qi))
        for s in range(0, len(qi), 1 << 18):
            e = s + (1 << 18)
            if d <= _FEW_DIMENSIONS:
                # Added up in the same order as below, without a matrix of differences.
                dist[s:e] = sum((a[qi[s:e], j] - c[ci[s:e], j]) ** 2 for j in range(d))
            else:
                dist[s:e] = ((a[qi[s:e]] - c[ci[s:e]]) ** 2).sum(axis=1)
        # Stable, so equal distances stay in the order of the candidates.
        order = np.lexsort((dist, qi))
        yield qi[order] + lo, ci[order], dist[order]


def _nearest(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray | None = None):
    """Best k of the id-ordered candidates for every query, within ``bound`` when given; a query's rows are together, by rank.

    Distances of the result are exact, so it does not depend on how the rows were divided among tasks.
    """
    empty = np.zeros(0, dtype=np.int64)
    parts = [(empty, empty, empty, np.zeros(0))]
    if bound is not None:
        bound = np.where(np.isnan(bound), np.inf, bound)
    if len(q) and len(c):
        for a, b in _near_parts(q, c, k, bound):
            for qi, ci, dist in _shortlist(q[a], c[b], k, None if bound is None else bound[a]):
                rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
                keep = rank < k
                parts.append((a[qi[keep]], b[ci[keep]], rank[keep] + 1, dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _nearest_stacks(q: np.ndarray, c: np.ndarray, k: int, offsets: np.ndarray, order: np.ndarray):
    """The k nearest members of stacks: pairs (query, stack) taken whole, and pairs (query, member) of stacks taken in part.

    Members of stack i are ``offsets[i]`` to ``offsets[i + 1]``; ``order`` ranks them by id, which breaks ties inside a stack
    and between stacks at the same distance. At most one distance per query is taken in part.
    """
    empty = np.zeros(0, dtype=np.int64)
    whole, part = [(empty, empty)], [(empty, empty)]
    held = np.diff(offsets)
    if len(q) and len(c):
        for a, b in _near_parts(q, c, k, held=held):
            sizes = held[b]
            for qi, ci, dist in _shortlist(q[a], c[b], min(k, math.ceil(k / sizes.min()))):
                first = np.searchsorted(qi, qi)
                n = sizes[ci]
                before = np.cumsum(n) - n
                before = before - before[first]
                new = np.append(True, (qi[1:] != qi[:-1]) | (dist[1:] != dist[:-1]))
                starts, tie = np.flatnonzero(new), np.cumsum(new) - 1
                nearer = before[starts][tie]
                ends = np.append(starts[1:], len(qi)) - 1
                through = (before + n)[ends][tie]
                all_ = through <= k
                whole.append((a[qi[all_]], b[ci[all_]]))
                some = np.flatnonzero((nearer < k) & (through > k))
                pair = np.repeat(some, n[some])
                inside = np.arange(len(pair)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                member = offsets[b[ci[pair]]] + inside
                by_id = np.lexsort((order[member], qi[pair]))
                pair, member = pair[by_id], member[by_id]
                keep = np.arange(len(pair)) - np.searchsorted(qi[pair], qi[pair]) < k - nearer[pair]
                part.append((a[qi[pair[keep]]], member[keep]))
    return tuple(np.concatenate(x) for x in zip(*whole)), tuple(np.concatenate(x) for x in zip(*part))
