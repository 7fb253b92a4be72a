"""Count, mean and scatter matrix of vectors in one pass, merged pairwise.

A task keeps one packed state per group (count, weight, mean, upper triangle of the centred scatter) and gives it as a single
row. States are merged in three levels of ``FAN_IN`` each until one per group is left, so up to ``FAN_IN**3`` input tasks no
merging task receives more than ``FAN_IN`` states, and the driver one per group. Merging works on centred sums: values far from 0 lose no digits.

Defined results: rows with a null vector, a null group of a given ``by``, a null component or a NaN are left out; a null
weight counts as 0; a group without rows gives no state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States that one group of a merging task holds.
FAN_IN = 64
# Elements of a matrix product inside a task.
_SLICE = 1 << 20
_FIELDS = "n long, weight double, mean array<double>, scatter array<double>"


@dataclass(frozen=True)
class Moments:
    """``n`` rows of total ``weight``, their mean and the sum of ``w (x - mean)(x - mean)'``."""

    n: int
    weight: float
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self) -> np.ndarray:
        """Sample covariance of unweighted rows; one row has none and gives zeros."""
        return self.scatter / max(self.weight - 1.0, 1.0)

    def second(self) -> np.ndarray:
        """``sum(w x x')`` around 0."""
        return self.scatter + self.weight * np.outer(self.mean, self.mean)


def merged(one: Moments | None, two: Moments) -> Moments:
    if one is None or not one.weight:
        return two if one is None else Moments(one.n + two.n, two.weight, two.mean, two.scatter)
    if not two.weight:
        return Moments(one.n + two.n, one.weight, one.mean, one.scatter)
    weight, gap = one.weight + two.weight, two.mean - one.mean
    scatter = one.scatter + two.scatter + np.outer(gap, gap) * (one.weight * two.weight / weight)
    return Moments(one.n + two.n, weight, one.mean + gap * (two.weight / weight), scatter)


def of_rows(x: np.ndarray, w: np.ndarray | None = None) -> Moments:
    w = np.ones(len(x)) if w is None else w
    total = float(w.sum())
    mean = w @ x / total if total else np.zeros(x.shape[1])
    centred = x - mean
    return Moments(len(x), total, mean, (centred * w[:, None]).T @ centred)


def packed(m: Moments) -> dict:
    return {"n": m.n, "weight": m.weight, "mean": m.mean.tolist(), "scatter": m.scatter[np.triu_indices(len(m.mean))].tolist()}


def unpacked(row: dict) -> Moments:
    mean = np.array(row["mean"])
    scatter = np.zeros((len(mean), len(mean)))
    scatter[np.triu_indices(len(mean))] = row["scatter"]
    return Moments(row["n"], row["weight"], mean, scatter + np.triu(scatter, 1).T)


def moment_states(
    df: DataFrame, vector: str | Column, weight: str | Column | None = None, by: str | Column | None = None,
    prepare: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, tasks: int | None = None,
) -> DataFrame:
    """One merged state per group: ``g, n, weight, mean, scatter``; groups are the few values of ``by``.

    ``prepare`` turns a batch's rows and weights into those to be summed up. ``tasks``, the number of input tasks where it is
    known, saves the levels that so many do not need; up to ``FAN_IN`` of them the states come unmerged.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(
        (F.lit(0) if by is None else col(by)).alias("g"), col(vector).cast("array<double>").alias("x"),
        (F.lit(1.0) if weight is None else F.coalesce(col(weight).cast("double"), F.lit(0.0))).alias("w"),
    ).where(F.col("g").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    kind = rows.schema["g"].dataType.simpleString()

    def gather(batches):
        states, arrow = {}, None
        for batch in batches:
            arrow = batch.schema.field("g").type
            coded = batch.column("g").dictionary_encode()
            codes, w = coded.indices.to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(batch.num_rows, -1) if batch.num_rows else x.reshape(0, 0)
            step = max(1, _SLICE // max(x.shape[1], 1))
            for code, g in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code)
                for lo in range(0, len(at), step):
                    part = at[lo : lo + step]
                    state = of_rows(x[part], w[part]) if prepare is None else of_rows(*prepare(x[part], w[part]))
                    states[g] = merged(states.get(g), state)
        if states:
            yield _batch(list(states), [packed(m) for m in states.values()], arrow)

    schema = f"g {kind}, {_FIELDS}"

    def merge(table: pa.Table) -> pa.Table:
        total = None
        # In an order of their own, so that a task run again gives the same digits.
        for row in sorted(table.drop_columns(["slot"]).to_pylist(), key=lambda r: (r["mean"], r["scatter"])):
            total = merged(total, unpacked(row))
        out = pa.Table.from_batches([_batch([table["g"][0].as_py()], [packed(total)], table.schema.field("g").type)])
        return out.append_column("slot", table["slot"].slice(0, 1))

    states = rows.mapInArrow(gather, schema).withColumn("slot", F.spark_partition_id())
    for slots in [n for n in (FAN_IN**2, FAN_IN, 1) if tasks is None or tasks > max(n, FAN_IN)]:
        states = states.withColumn("slot", F.col("slot") % slots).groupBy("g", "slot").applyInArrow(merge, f"{schema}, slot int")
    return states.drop("slot")


def moments(
    df: DataFrame, vector: str | Column, weight: str | Column | None = None, by: str | Column | None = None, prepare=None,
    tasks: int | None = None,
) -> dict:
    """The states on the driver: one matrix of d x d per group, and of at most ``FAN_IN`` tasks where ``tasks`` is given."""
    rows = [r.asDict() for r in moment_states(df, vector, weight, by, prepare, tasks).collect()]
    out: dict = {}
    for row in sorted(rows, key=lambda r: (r["mean"], r["scatter"])):
        out[row["g"]] = merged(out.get(row["g"]), unpacked(row))
    return out


def _batch(groups: list, rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(groups, kind), pa.array([r["n"] for r in rows], pa.int64()), pa.array([r["weight"] for r in rows], pa.float64())]
    columns += [pa.array([r[c] for r in rows], pa.list_(pa.float64())) for c in ("mean", "scatter")]
    return pa.RecordBatch.from_arrays(columns, ["g", "n", "weight", "mean", "scatter"])


def principal_components(m: Moments, share: float = 0.9) -> np.ndarray:
    """The fewest leading directions that hold ``share`` of the variance, as columns; each one's largest entry is positive."""
    values, vectors = np.linalg.eigh(m.scatter)
    values, vectors = values[::-1].clip(min=0), vectors[:, ::-1]
    total = values.sum()
    keep = 1 if not total else int(np.searchsorted(np.cumsum(values) / total, share - 1e-12)) + 1
    vectors = vectors[:, : min(keep, len(values))]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def projected(df: DataFrame, vector: str, mean: np.ndarray, directions: np.ndarray, out: str) -> DataFrame:
    """The vector around ``mean`` in the given directions; a row that has no usable vector gets null."""

    def run(batches):
        for batch in batches:
            raw = batch.column("_x")
            rows = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False))
            x = raw.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, len(mean)))
            result = [None] * batch.num_rows
            for at, value in zip(rows, ((x - mean) @ directions).tolist()):
                result[at] = value
            yield batch.drop_columns(["_x"]).append_column(out, pa.array(result, pa.list_(pa.float64())))

    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a))
    kept = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` array<double>"
    return df.select(*[f"`{f.name}`" for f in kept], F.when(usable, v).alias("_x")).mapInArrow(run, schema)
