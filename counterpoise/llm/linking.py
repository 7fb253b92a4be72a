"""Connected groups of linked rows, and the bounded pieces in which candidates are compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.session import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``a, b``.

    Alternates two star contractions (link every neighbour to the smallest neighbour, first upwards, then downwards) until
    nothing changes. Each round is a few aggregates and joins of a written table: no group is gathered in one task, and
    only a count and two checksums reach the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = stage(pairs, name), None
    while True:
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        up = pairs.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        root = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stage(down.union(root.select("u", F.col("m").alias("v"))).distinct(), name)


def in_tiles(members: DataFrame, group: list[str], row_key: Column, weight: Column, per_tile: int) -> DataFrame:
    """Adds ``lo, hi``: rows of one group meet in pieces that hold two tiles of about ``per_tile`` weight each.

    A group of up to one tile is one piece. A larger one is cut into tiles by a hash of the rows, and each pair of tiles is
    a piece, so that every pair of rows meets and no piece grows with its group.
    """
    sizes = members.groupBy(*group).agg(F.sum(weight).alias("w"), F.count("*").alias("c")).where("c > 1")
    sizes = sizes.select(*group, F.ceil(F.col("w") / F.lit(per_tile)).cast("int").alias("tiles"))
    rows = members.join(sizes, group).withColumn("tile", F.pmod(F.xxhash64(row_key), F.col("tiles").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("tiles"), F.lit(1)) - 1)))
    return rows.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).drop("other", "tiles")


def by_piece(rows: DataFrame, group: list[str]) -> DataFrame:
    """Pieces whole and in order within partitions, for ``whole_runs``."""
    keys = [*group, "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of equal keys, and the runs' offsets. The keys are integers."""
    rest: list[pa.Table] = []
    last = None

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            values = table[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        new[0] = True
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts = cut(table)
        first = tuple(table[k][0].as_py() for k in keys)
        if rest and first == last and len(starts) == 1:
            rest.append(table)
            continue
        whole, rest_next = table.slice(0, starts[-1]), table.slice(starts[-1])
        if rest and first != last:
            done = pa.concat_tables(rest)
            yield done, np.append(cut(done), done.num_rows)
            rest = []
        if whole.num_rows:
            done = pa.concat_tables([*rest, whole])
            yield done, np.append(cut(done), done.num_rows)
            rest = []
        rest.append(rest_next)
        last = tuple(rest_next[k][0].as_py() for k in keys)
    if rest:
        done = pa.concat_tables(rest)
        yield done, np.append(cut(done), done.num_rows)


def spanning_links(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what is connected among ``n`` rows: at most ``n - 1`` of them, however many pairs are near.

    ``near(i, rest)`` says which of the rows ``rest`` are near row ``i``. Rows already reached are not compared again.
    """
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                reached = rest[hit]
                out += [(i, int(j)) for j in reached]
                queue += reached.tolist()
                rest = rest[~hit]
    return out
