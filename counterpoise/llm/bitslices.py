"""Exact top-k inner products on a bit-sliced index.

The index keeps, for every block of rows and every component, the quantised values as bit slices: packed bitmaps with one
bit per row. A query's scores are added up with bitmap arithmetic: for each set bit of each weight the component's slices
enter a carry-save adder, one ripple-carry addition ends it. The k best rows are then read off the score's slices, from
the most significant one downward; rows that tie at the boundary are resolved by their id.

Queries and blocks meet block by block: the index is built once, each task holds one block of rows and one of queries and
returns k rows per query, and the last step keeps the k best of those.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no part; shorter vectors
count as padded with zeros; components so large that a sum of products might not fit a long fail; equal scores are ordered
by the smaller id; repeated ids are separate candidates, but a query never meets rows of its own id; a query row that repeats
counts once, and query rows that share an id but not the vector have a list each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterpoise.llm.hard_negatives import quantised
from counterpoise.session import stage

class BlockIndex:
    """Bit slices of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        values = values[order]
        self.rows, self.dims = values.shape
        self.words = -(-self.rows // 64)
        self.low = values.min(axis=0)
        self.top = values.max(axis=0) - self.low
        width = [max(1, int(t).bit_length()) for t in self.top]
        shifted = (values - self.low).astype(np.uint64)
        self.slices = [np.stack([self._bitmap((shifted[:, j] >> np.uint64(b)) & np.uint64(1)) for b in range(w)]) for j, w in enumerate(width)]
        self.valid = self._bitmap(np.ones(self.rows, dtype=np.uint64))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of the scores less a constant, most significant last, and the constant."""
        weights = np.concatenate([weights, np.zeros(max(0, self.dims - len(weights)), dtype=weights.dtype)])[: self.dims]
        # A negative weight takes the complement of its slices, so that only sums of non-negative numbers occur.
        constant = int((weights * self.low).sum())
        most = 0
        terms = []
        for j in np.flatnonzero(weights):
            weight, part = int(weights[j]), self.slices[j]
            full = (1 << len(part)) - 1
            if weight < 0:
                part = ~part
                constant += weight * full
            most += abs(weight) * full
            terms += [(part, b) for b in range(abs(weight).bit_length()) if abs(weight) >> b & 1]
        depth = max(1, most.bit_length())
        total, carry = np.zeros((2, depth, self.words), dtype=np.uint64)
        both, either = np.empty_like(total), np.empty_like(total)
        for part, b in terms:
            # Slices outside the term are zero there: sum = total ^ carry, carry = total & carry.
            np.bitwise_and(total, carry, out=both)
            np.bitwise_xor(total, carry, out=either)
            inside = slice(b, b + len(part))
            both[inside] |= either[inside] & part
            either[inside] ^= part
            total, either = either, total
            carry[1:] = both[:-1]
        while carry.any():
            both = total & carry
            total = total ^ carry
            carry = np.zeros_like(carry)
            carry[1:] = both[:-1]
        return total, constant

    def top_rows(self, total: np.ndarray, k: int, mask: np.ndarray) -> np.ndarray:
        """Places of the k best rows of the mask; ties go to the smaller place."""
        sure, tied = np.zeros_like(mask), mask.copy()
        for row in total[::-1]:
            higher = tied & row
            n = int(np.bitwise_count(sure | higher).sum())
            if n > k:
                tied = higher
            else:
                sure |= higher
                tied &= ~row
                if n == k:
                    break
        chosen = self._places(sure)
        boundary = self._places(tied)[: max(0, k - len(chosen))]
        return np.concatenate([chosen, boundary])

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def top(self, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows with another id than ``own``."""
        mask = self.valid
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        if last > first:
            mask = mask.copy()
            for place in range(first, last):
                mask[place // 64] &= ~(np.uint64(1) << np.uint64(place % 64))
        total, constant = self.scores(weights)
        rows = self.top_rows(total, k, mask)
        bits = (total[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
        values = (bits.astype(np.int64) << np.arange(len(total), dtype=np.int64)[:, None]).sum(axis=0) + constant
        return self.ids[rows], values


def _built(table: pa.Table, dims: int) -> BlockIndex:
    values = np.zeros((table.num_rows, dims), dtype=np.int64)
    column = table["q"].combine_chunks()
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    values[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return BlockIndex(table["id"].to_numpy(), values)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
    block_rows: int = 8192, query_rows: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best candidates among all ``vectors`` but its own id."""
    side = lambda df: df.select(F.col(key).cast("long").alias("id"), quantised(vector, scale).alias("q")).where("id IS NOT NULL AND q IS NOT NULL")
    # Of rows alike in id and vector only k can be among the k best.
    rows = side(vectors).groupBy("id", "q").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    rows = stage(rows.select("id", "q", "copy"), "bitslice-rows")
    asked = stage(side(queries).distinct().withColumn("r", F.monotonically_increasing_id()), "bitslice-queries")
    largest = F.coalesce(F.max(F.aggregate("q", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))), F.lit(0))
    count, dims, high = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1)), largest).first()
    # Room for the index's shifted values and the carries of its sums.
    if dims * high * asked.agg(largest).first()[0] >= 1 << 60:
        raise ValueError("a score may not fit a long")
    blocks = max(1, -(-count // block_rows))
    chunks = max(1, -(-asked.count() // query_rows))

    def build(key_: tuple, table: pa.Table) -> pa.Table:
        index = _built(table, dims)
        bits = b"".join(x.tobytes() for x in index.slices)
        return pa.table({
            "block": pa.array([key_[0].as_py()], pa.int32()), "ids": pa.array([index.ids.tobytes()], pa.binary()),
            "low": pa.array([index.low.tobytes()], pa.binary()), "widths": pa.array([[len(x) for x in index.slices]], pa.list_(pa.int32())),
            "bits": pa.array([bits], pa.binary()),
        })

    block = F.pmod(F.xxhash64("id", "q", "copy"), F.lit(blocks)).cast("int")
    index = rows.withColumn("block", block).groupBy("block").applyInArrow(build, "block int, ids binary, low binary, widths array<int>, bits binary")
    index = stage(index, "bitslice-index")

    def answer(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"r": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows:
            loaded = load_block(left.slice(0, 1).to_pylist()[0])
            for r, own, weights in zip(right["r"].to_pylist(), right["id"].to_pylist(), right["q"].to_pylist()):
                ids, scores = loaded.top(own, np.array(weights, dtype=np.int64), k)
                out["r"].append(np.full(len(ids), r))
                out["query_id"].append(np.full(len(ids), own))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        return pa.table({c: pa.array(np.concatenate([np.empty(0, np.int64), *v]), pa.int64()) for c, v in out.items()})

    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id", "q"), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "chunk"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(answer, "r long, query_id long, vec_id long, score long")
    best = Window.partitionBy("r").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def load_block(row: dict) -> BlockIndex:
    """A block as the index table stores it."""
    index = BlockIndex.__new__(BlockIndex)
    index.ids, index.low = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64)
    index.rows, index.dims, index.words = len(index.ids), len(index.low), -(-len(index.ids) // 64)
    bits = np.frombuffer(row["bits"], np.uint64).reshape(-1, index.words)
    ends = np.cumsum(row["widths"])
    index.slices = [bits[end - width : end] for end, width in zip(ends, row["widths"])]
    index.valid = index._bitmap(np.ones(index.rows, dtype=np.uint64))
    return index
