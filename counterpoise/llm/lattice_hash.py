"""Near-duplicate vectors by hashing random projections to points of the E8 lattice.

Each of several tables projects the unit vectors to eight dimensions and decodes them to the nearest lattice point. A vector
enters its own cell and the neighbouring cells whose points come next, so two close vectors meet in some table although a
cell border lies between them. Rows that meet are compared on 16-bit copies of the vectors with a margin that covers their
rounding; the classes this forms are then compared in double precision, pair by pair, which gives the links, their number
for each vector, and the connected groups. Equal vectors are represented by their smallest id.

Recall of a pair at cosine 0.9 is 0.99 with the default tables, and higher above; inside a class every pair is compared.
Cells and classes of any size are cut into tiles whose pairs meet in bounded pieces.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing and are
their own component; vectors of different length never link; equal vectors always link; rows that repeat an id count as
separate vectors; labels and other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.hashing import mix
from counterpoise.llm.linking import by_piece, components, in_tiles, spanning_links, whole_runs
from counterpoise.session import stage


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_MINIMAL = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and where the sum is odd round the worst entry the other way."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    error = x - point
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: the better of the even-sum points and of those shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def cells(unit: np.ndarray, table: int, probes: int, cell: float, seed: int = 8) -> np.ndarray:
    """Cell keys of unit vectors in one table, the own cell first: shape (rows, probes)."""
    dims = max(unit.shape[1], 8)
    if unit.shape[1] < 8:
        unit = np.pad(unit, ((0, 0), (0, 8 - unit.shape[1])))
    # Orthogonal directions, stretched so that lengths keep their expectation.
    basis, _ = np.linalg.qr(np.random.default_rng([seed, table, dims]).normal(size=(dims, 8)))
    x = unit @ basis * (np.sqrt(dims / 8) / cell)
    own = nearest_e8(x)
    points = own[:, None, :]
    if probes > 1:
        gain = (x - own) @ _MINIMAL.T
        order = np.argsort(-gain, axis=1, kind="stable")[:, : probes - 1]
        points = np.concatenate([points, own[:, None, :] + _MINIMAL[order]], axis=1)
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = np.full(points.shape[:2], np.uint64(table * 1_000_003 + dims))
    for i in range(8):
        key = mix(key + twice[:, :, i] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def usable(vector: str | Column) -> Column:
    """Finite, non-zero vectors as array<double>; null for all others."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    doubles = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(doubles, lambda x: x != 0)
    return F.when(good, doubles)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components would leave the range of doubles.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, tables: int = 7, probes: int = 4, cell: float = 0.45,
    tile_rows: int = 2048,
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every vector."""
    rows = stage(vectors.select(F.col(key).cast("long").alias("k"), usable(vector).alias("v")), "vectors")
    copies = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("k").alias("rep"), F.count("*").alias("copies"))
    # Distinct vectors get an id of their own: a repeated key may stand for several of them.
    copies = stage(copies.select("rep", "copies", "v", F.size("v").alias("dims"), F.xxhash64("rep", "v").alias("id")), "vector-copies")
    classes = components(_meetings(copies, cosine, tables, probes, cell, tile_rows), "vector-classes")
    found = stage(_compared(copies.join(classes.select(F.col("node").alias("id"), F.col("component").alias("class")), "id"), cosine, tile_rows), "vector-links")
    groups = components(found.where("b IS NOT NULL").select("a", "b"), "vector-components")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    named = copies.join(groups.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").select(
        "v", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("group"),
    )
    named = stage(named, "vector-named")
    smallest = named.groupBy("group").agg(F.min("rep").alias("smallest"))
    named = named.join(smallest, "group").select("v", "n_links", "smallest")
    out = rows.join(named, "v", "left")
    component = F.coalesce("smallest", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("k") == component).alias("kept"))


def _meetings(copies: DataFrame, cosine: float, tables: int, probes: int, cell: float, tile_rows: int) -> DataFrame:
    @F.arrow_udf(T.StructType([T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("short", T.BinaryType())]))
    def hashed(column: pa.Array) -> pa.Array:
        lengths = np.diff(column.offsets.to_numpy())
        keys, short = [None] * len(column), [None] * len(column)
        for dims in np.unique(lengths):
            at = np.flatnonzero(lengths == dims)
            unit = _unit(_matrix(column.take(pa.array(at))))
            found = np.concatenate([cells(unit, t, probes, cell) for t in range(tables)], axis=1)
            codes = np.rint(unit * 32767).astype(np.int16)
            for i, row in enumerate(at):
                keys[row], short[row] = found[i], codes[i].tobytes()
        return pa.StructArray.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["cells", "short"])

    hashes = stage(copies.select("id", "dims", hashed("v").alias("h")).select("id", "dims", "h.*"), "vector-cells")
    members = hashes.select("id", F.explode(F.array_distinct("cells")).alias("cell"), "dims")
    pieces = in_tiles(members, ["dims", "cell"], F.col("id"), F.lit(1), tile_rows).select("dims", "cell", "lo", "hi", "id")
    pieces = by_piece(pieces.join(hashes.select("id", "short"), "id"), ["dims", "cell"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["dims", "cell", "lo", "hi"]):
            ids, dims, codes = table["id"].to_numpy(), table["dims"].to_numpy(), table["short"].to_pylist()
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
                d = int(dims[start])
                unit = np.frombuffer(b"".join(codes[start:end]), dtype=np.int16).reshape(-1, d).astype(np.float32) / np.float32(32767)
                # Rounding moves a vector by at most sqrt(d) / 2 steps.
                least = cosine - 1.1 * np.sqrt(d) / 32767 - 1e-5
                left, right = _near_pairs(unit, least)
                a.append(ids[start + left])
                b.append(ids[start + right])
            yield pa.record_batch({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return pieces.mapInArrow(met, "a long, b long")


def _near_pairs(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what is near, all of them where they are few."""
    n = len(unit)
    if n <= 64:
        left, right = np.nonzero(np.triu(unit @ unit.T >= least, 1))
        if len(left) <= n:
            return left, right
    found = spanning_links(n, lambda i, rest: unit[rest] @ unit[i] >= least)
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _compared(members: DataFrame, cosine: float, tile_rows: int) -> DataFrame:
    """Links ``a, b`` that connect each piece, and rows ``a, null, n`` with the vectors linked to ``a`` in a piece."""
    pieces = in_tiles(members.select("class", "id", "copies"), ["class"], F.col("id"), F.lit(1), tile_rows)
    pieces = by_piece(pieces.select("class", "lo", "hi", "tile", "id").join(members.select("id", "copies", "v"), "id"), ["class"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["class", "lo", "hi"]):
            ids, copies, tiles = table["id"].to_numpy(), table["copies"].to_numpy(), table["tile"].to_numpy()
            low, high = table["lo"].to_numpy(), table["hi"].to_numpy()
            vectors = table["v"].combine_chunks()
            a, b, n = [], [], []
            for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
                unit = _unit(_matrix(vectors.slice(start, end - start)))
                near = unit @ unit.T >= cosine
                np.fill_diagonal(near, False)
                if low[start] != high[start]:
                    # Pairs within a tile are counted in that tile's own piece.
                    near &= tiles[start:end, None] != tiles[None, start:end]
                for i, j in spanning_links(end - start, lambda i, rest: near[i, rest]):
                    a.append(int(ids[start + i]))
                    b.append(int(ids[start + j]))
                    n.append(None)
                linked = near @ copies[start:end]
                for i in np.flatnonzero(linked):
                    a.append(int(ids[start + i]))
                    b.append(None)
                    n.append(int(linked[i]))
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return pieces.mapInArrow(compared, "a long, b long, n long")
