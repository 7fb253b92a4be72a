"""Boosted trees for propensities and, without a detour, for inverse propensities, with a search that stops early.

The inverse propensity minimises ``mean(S f^2 - 2 f)``; MLlib's trees know no such loss. Here a loss is its gradient and
curvature, and a tree grows level by level from histograms: each task sums gradient, curvature and rows per open node,
feature and bin, the sums of all tasks are added up, and the driver picks the splits from a table whose size depends on the
settings alone. The value of a leaf is the Newton step ``-G / H``, for the inverse propensity from 0 exactly ``n / n1``.

Rows are binned once; rows alike in bins, flag, part and validation become one with their number, and are written. Every sum is
taken with that number, so the trees are those of the single rows, while a pass reads at most as many rows as the bins have
combinations, however long the table. All candidates of a search, and both folds of a cross-fit, grow in the same passes over
that table. Up to ``_HELD_BYTES`` it is held as arrays on the driver, where a pass needs no job; a larger one is read by a job
per level. A candidate ends when its loss on the validation rows has not improved for ``patience`` trees; at each tree
number of ``halve_at`` only the better half of a part's candidates goes on. The scores so far are kept, or written every few
trees, so that no pass has to apply a whole ensemble and none depends on more than one table.

A tree may draw each row with chance ``row_share``. Of a stack of rows alike it draws a binomial number, which a hash of the
stack, the tree and the seed fixes: the same in every pass and in a recomputed task, and distributed as if each row were drawn
by itself. ``feature_share`` of the features, rounded up, may split a node.

Null and NaN features fall into the lowest bin; a null flag counts as 0; rows without a part or with a null one train every
candidate that names none. A candidate without rows has no trees. Equal gains take the earlier feature and the lower cut, whatever the order in which sums arrive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.features import flag_label
from counterpoise.session import stage

_TASK_ROWS = 25_000
# Most bytes of rows alike, with the state of all candidates, that are held on the driver.
_HELD_BYTES = 128 << 20
# Trees that a pass applies on top of the written scores.
_REFRESH = 10


@dataclass(frozen=True)
class Loss:
    """Constant minimiser from rows and treated rows, gradient and curvature, and the loss itself, each by row.

    ``first`` is the rate of the first tree where it differs from the others'.
    """

    start: Callable[[float, float], float]
    slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    first: float | None = None


def _logistic_slopes(f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-f))
    return p - s, p * (1.0 - p)


def _deviance_slopes(f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = 2.0 * s - 1.0
    return -4.0 * y / (1.0 + np.exp(2.0 * y * f)), np.ones(len(f))


# "deviance" is MLlib's boosting of labels -1 and 1: f is half the logit, leaves are mean residuals, and the first tree is
# fitted to the labels, which are half the residuals at 0, with weight 1.
LOSSES = {
    "deviance": Loss(lambda n, n1: 0.0, _deviance_slopes, lambda f, s: 2.0 * np.logaddexp(0.0, (2.0 - 4.0 * s) * f), first=0.5),
    "inverse": Loss(lambda n, n1: n / max(n1, 1.0), lambda f, s: (2.0 * s * f - 2.0, 2.0 * s), lambda f, s: s * f * f - 2.0 * f),
    "logistic": Loss(lambda n, n1: math.log((n1 + 0.5) / (n - n1 + 0.5)), _logistic_slopes, lambda f, s: np.logaddexp(0.0, f) - s * f),
}


@dataclass(frozen=True)
class Candidate:
    """Settings of one ensemble; ``part`` names the rows it is fitted on, None all of them."""

    depth: int = 5
    rate: float = 0.1
    trees: int = 100
    min_rows: int = 20
    part: int | None = None
    row_share: float = 1.0
    feature_share: float = 1.0
    seed: int = 42


@dataclass(frozen=True, eq=False)
class Tree:
    """A binary heap: children of i are 2i+1 (bin up to the cut) and 2i+2; a node without a feature (-1) is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = (2 << depth) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def node(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            feature = self.feature[at]
            below = 2 * at + 1 + (bins[rows, feature] > self.cut[at])
            at = np.where(feature < 0, at, below)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node(bins)]


@dataclass(frozen=True, eq=False)
class Binning:
    """Cuts of every feature: the bin of x is the number of cuts below x."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], max_bins: int = 64) -> Binning:
        """Every value a bin of its own in features of few values, else approximate quantiles."""
        values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
        shares = [i / max_bins for i in range(1, max_bins)]
        row = df.agg(
            *[F.approx_count_distinct(values[c], 0.02).alias(f"n{i}") for i, c in enumerate(features)],
            *[F.percentile_approx(values[c], shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)],
        ).first()
        few = [c for i, c in enumerate(features) if row[f"n{i}"] <= max_bins]
        kept = df.agg(*[F.collect_set(values[c]).alias(c) for c in few]).first() if few else None
        cuts = []
        for i, c in enumerate(features):
            points = sorted(kept[c])[:-1] if c in few else sorted(set(row[f"q{i}"] or ()))
            cuts.append(np.array(points, dtype=np.float64))
        return cls(tuple(features), tuple(cuts))

    def bins(self, rows: np.ndarray) -> np.ndarray:
        """Bins of a matrix of feature values."""
        out = np.empty(rows.shape, dtype=np.int16)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.searchsorted(cuts, np.where(np.isnan(rows[:, j]), -np.inf, rows[:, j]), "left")
        return out

    def column(self) -> Column:
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features])


@dataclass(frozen=True, eq=False)
class Ensemble:
    """A fitted model: ``scores`` are f itself; ``loss`` tells what f means."""

    loss: str
    binning: Binning
    start: float
    trees: tuple[Tree, ...]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        bins = self.binning.bins(rows)
        return self.start + sum((t.scores(bins) for t in self.trees), np.zeros(len(rows)))

    def score(self, df: DataFrame, out: str = "f") -> DataFrame:
        """Adds the inverse propensity (at least 1), or the probability of class 1."""
        width = len(self.binning.features)

        @F.arrow_udf("double")
        def scored(values: pa.Array) -> pa.Array:
            f = self.scores(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width))
            return pa.array(np.maximum(f, 1.0) if self.loss == "inverse" else 1.0 / (1.0 + np.exp(-2.0 * f if self.loss == "deviance" else -f)))

        return df.withColumn(out, scored(self.binning.column()))


@dataclass
class _Growing:
    """One candidate on its way: finished trees, the tree being grown, and the losses on the validation rows so far."""

    number: int
    settings: Candidate
    start: float = 0.0
    first: float | None = None
    rows: int = 0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    written: int = 0
    status: str = "growing"
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    rung: int = -1

    def begin(self) -> None:
        self.tree, self.open = Tree.empty(self.settings.depth), [0]

    @property
    def best(self) -> int:
        """Trees at the lowest loss; all of them without validation rows."""
        return int(np.argmin(self.losses)) if self.validated else len(self.trees)

    @property
    def validated(self) -> bool:
        return bool(self.losses) and not math.isnan(self.losses[0])

    def split(self, sums: np.ndarray, cuts: list[int]) -> None:
        """Split the open nodes from sums by (node, feature, bin, [gradient, curvature, rows]); leaves get their values."""
        following, first = [], not (self.tree.feature >= 0).any()
        for node, own in zip(self.open, sums):
            total = own[0].sum(axis=0)
            if first:
                self.tree.value[node] = self._step(total)
            gain, feature, cut, left = 0.0, -1, 0, None
            for j in self._features(node, len(cuts)):
                low = own[j].cumsum(axis=0)[: cuts[j]]
                high = total - low
                fits = (low[:, 2] >= self.settings.min_rows) & (high[:, 2] >= self.settings.min_rows) & (low[:, 1] > 1e-9) & (high[:, 1] > 1e-9)
                if not fits.any():
                    continue
                gains = np.where(fits, _gain(low) + _gain(high) - _gain(total[None])[0], -np.inf)
                at = int(np.flatnonzero(gains >= gains.max() - 1e-9 * abs(gains.max()))[0])
                if gains[at] > gain * (1 + 1e-9) + 1e-12 * (1 + abs(total[0])):
                    gain, feature, cut, left = gains[at], j, at, low[at]
            if feature >= 0:
                self.tree.feature[node], self.tree.cut[node] = feature, cut
                for child, part in ((2 * node + 1, left), (2 * node + 2, total - left)):
                    self.tree.value[child] = self._step(part)
                    following.append(child)
        deepest = not following or math.floor(math.log2(following[0] + 1)) >= self.settings.depth
        self.open = [] if deepest else following

    def _step(self, total: np.ndarray) -> float:
        rate = self.settings.rate if self.trees or self.first is None else self.first
        return -rate * total[0] / total[1] if total[1] > 1e-9 else 0.0

    def _features(self, node: int, n: int) -> list[int]:
        """The features that may split a node, in order."""
        some = math.ceil(self.settings.feature_share * n)
        if some >= n:
            return list(range(n))
        return sorted(np.random.default_rng([self.settings.seed, self.number, len(self.trees), node]).choice(n, some, replace=False).tolist())

    @property
    def purpose(self) -> int:
        """Names the draws of the tree being grown."""
        return (self.settings.seed * 1_000_003 + self.number) * 1_000_003 + len(self.trees)


def _gain(sums: np.ndarray) -> np.ndarray:
    return sums[:, 0] ** 2 / np.maximum(sums[:, 1], 1e-12)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=256)
def _binomial(n: int, share: float) -> tuple[int, np.ndarray]:
    """Distribution function of the number drawn of ``n`` rows, from the number returned on; what lies 12 deviations off is left out."""
    reach = 12.0 * math.sqrt(n * share * (1.0 - share)) + 12.0
    least, most = max(0, math.floor(n * share - reach)), min(n, math.ceil(n * share + reach))
    k = np.arange(least + 1, most + 1)
    logs = np.append(0.0, np.cumsum(np.log((n - k + 1) / k) + math.log(share / (1.0 - share))))
    total = np.cumsum(np.exp(logs - logs.max()))
    return least, total / total[-1]


def _drawn(stacks: np.ndarray, rows: np.ndarray, share: float, purpose: int) -> np.ndarray:
    """How many rows of each stack a tree draws: one binomial number for each power of two in the stack's rows."""
    out = np.zeros(len(rows))
    for j in range(int(rows.max(initial=0)).bit_length()):
        has = np.flatnonzero((rows >> j) & 1)
        salt = _mixed(np.array([(purpose * 64 + j) % (1 << 64)], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        chance = (_mixed(stacks[has].view(np.uint64) ^ salt) >> np.uint64(11)) * 2.0**-53
        least, below = _binomial(1 << j, share)
        out[has] += least + np.searchsorted(below, chance, "right")
    return out


def _inside(candidate: Candidate, part: np.ndarray) -> np.ndarray:
    return np.ones(len(part), dtype=bool) if candidate.part is None else part == candidate.part


def _read(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, ...]:
    """Bins, flag, part, validation flag, number of rows, hash and written scores of a batch of the binned table."""
    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
    return bins, *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "part", "valid", "rows", "stack")], f


class _Held:
    """A binned table as arrays, with each candidate's scores so far and the places of its rows in the tree being grown."""

    def __init__(self, table: pa.Table, growing: list[_Growing], features: int):
        # In one order whatever task a row comes from, so that the sums are the same in every run.
        table = table.take(np.argsort(table["stack"].to_numpy(), kind="stable")).combine_chunks()
        self._rows, self._parts, self._fitted = table.num_rows, {}, {}
        bins = table["bins"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(self._rows, features)
        columns = [table[c].to_numpy() for c in ("s", "part", "valid", "rows", "stack")]
        for c in growing:
            if c.settings.part not in self._parts:
                inside = _inside(c.settings, columns[1])
                self._parts[c.settings.part] = bins[inside], *[x[inside] for x in columns]
        self._f = {c.number: np.full(len(self._parts[c.settings.part][0]), c.start) for c in growing}

    @staticmethod
    def fits(rows: int, features: int, candidates: int) -> bool:
        return rows * (4 * features + 64 + (4 * features + 64) * candidates) <= _HELD_BYTES

    def count(self) -> int:
        return self._rows

    def level(self, c: _Growing, loss: str, cuts: list[int]) -> tuple[np.ndarray, float]:
        """What ``_level`` finds for one candidate."""
        width, features, tested = max(cuts) + 1, len(cuts), float("nan")
        if c.open == [0]:
            bins, s, _, valid, alike, stacks = self._parts[c.settings.part]
            f = self._f[c.number]
            for tree in c.trees[c.written :]:
                f += tree.scores(bins)
            c.written = len(c.trees)
            if valid.any():
                tested = float(alike[valid] @ LOSSES[loss].value(f[valid], s[valid]) / alike[valid].sum())
            if c.settings.row_share < 1:
                alike = _drawn(stacks, np.where(valid, 0, alike), c.settings.row_share, c.purpose)
            rows = np.flatnonzero(~valid & (alike > 0))
            g, h = LOSSES[loss].slopes(f[rows], s[rows])
            bins, at, weights = bins[rows], np.zeros(len(rows), np.int64), [x * alike[rows] for x in (g, h, 1.0)]
        else:
            bins, at, weights = self._fitted[c.number]
            feature = c.tree.feature[at]
            rows = np.flatnonzero(feature >= 0)
            at, feature = at[rows], feature[rows]
            bins, weights = bins[rows], [x[rows] for x in weights]
            at = 2 * at + 1 + (bins[np.arange(len(rows)), feature] > c.tree.cut[at])
        self._fitted[c.number] = bins, at, weights
        slot = np.full(len(c.tree.feature), -1)
        slot[c.open] = np.arange(len(c.open))
        own = slot[at] * width
        sums = np.zeros((len(c.open), features, width, 3))
        for j in range(features):
            place = own + bins[:, j]
            for i, x in enumerate(weights):
                sums[:, j, :, i] = np.bincount(place, x, len(c.open) * width).reshape(-1, width)
        return sums, tested


def _level(table: DataFrame | _Held, live: list[_Growing], n: int, loss: str, cuts: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """One pass: sums of each live candidate's open nodes, and at a tree's root the loss on its validation rows."""
    if isinstance(table, _Held):
        return {(c.number, i): x for c in live for i, x in enumerate(table.level(c, loss, cuts))}
    width, features = max(cuts) + 1, len(cuts)
    jobs = [(c.number, c.settings, c.trees[c.written :], c.tree, list(c.open), c.purpose) for c in live]
    slopes, value = LOSSES[loss].slopes, LOSSES[loss].value

    def summed(batches):
        sums = {number: np.zeros((3, len(nodes) * features * width)) for number, _, _, _, nodes, _ in jobs}
        losses = {number: np.zeros(2) for number, *_ in jobs}
        for batch in batches:
            all_bins, *others, written = _read(batch, n)
            for number, settings, fresh, tree, nodes, purpose in jobs:
                inside = _inside(settings, others[1])
                bins, (s, _, valid, alike, stacks) = all_bins[inside], [x[inside] for x in others]
                f = written[inside, number] + sum((t.scores(bins) for t in fresh), np.zeros(len(bins)))
                if nodes == [0]:
                    losses[number] += alike[valid] @ value(f[valid], s[valid]), alike[valid].sum()
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                own = slot[tree.node(bins)]
                rows = ~valid & (own >= 0)
                own, bins, alike = own[rows], bins[rows], alike[rows]
                if settings.row_share < 1:
                    alike = _drawn(stacks[rows], alike, settings.row_share, purpose)
                g, h = slopes(f[rows], s[rows])
                for j in range(features):
                    place = (own * features + j) * width + bins[:, j]
                    for i, w in enumerate((g * alike, h * alike, alike)):
                        sums[number][i] += np.bincount(place, w, sums[number].shape[1])
        for number, total in sums.items():
            some = np.flatnonzero(total[2])
            places, parts = np.append(some, -1), np.column_stack([total[:, some], [losses[number][0], 0.0, losses[number][1]]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(places), number, np.int32)), pa.array(places), *map(pa.array, parts)], names=["number", "place", "g", "h", "n"],
            )

    found = table.mapInArrow(summed, "number int, place long, g double, h double, n double").groupBy("number", "place")
    found = found.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    number, place = found["number"].to_numpy(), found["place"].to_numpy()
    sums = np.column_stack([found[c].to_numpy() for c in ("g", "h", "n")])
    out = {}
    for c in live:
        own = (number == c.number) & (place >= 0)
        total = np.zeros((len(c.open) * features * width, 3))
        total[place[own]] = sums[own]
        out[c.number, 0] = total.reshape(len(c.open), features, width, 3)
        tested = sums[(number == c.number) & (place < 0)].sum(axis=0)
        out[c.number, 1] = tested[0] / tested[2] if tested[2] else float("nan")
    return out


def _applied(table: DataFrame, fresh: dict[int, list[Tree]], n: int) -> DataFrame:
    """The table with the scores of more trees added."""

    def added(batches):
        for batch in batches:
            bins, *_, f = _read(batch, n)
            f = f.copy()
            for number, trees in fresh.items():
                for tree in trees:
                    f[:, number] += tree.scores(bins)
            lists = pa.ListArray.from_arrays(np.arange(0, f.size + 1, n, dtype=np.int32), f.ravel())
            yield batch.set_column(batch.schema.get_field_index("f"), "f", lists)

    return stage(table.mapInArrow(added, table.schema), "boosting-scores")


@dataclass(frozen=True)
class Search:
    """Each candidate's model, cut to its best tree number, and the table of all of them."""

    models: tuple[Ensemble, ...]
    candidates: tuple[Candidate, ...]
    losses: tuple[float, ...]
    grown: tuple[int, ...]
    statuses: tuple[str, ...]

    def best(self, part: int | None = None) -> Ensemble:
        own = [i for i, c in enumerate(self.candidates) if c.part == part]
        return self.models[min(own, key=lambda i: (self.losses[i], i))]

    def table(self, df: DataFrame) -> DataFrame:
        """``part, max_depth, rate, trees, grown, loss, status``: trees kept and grown, and the loss at the kept number."""
        rows = [
            (c.part, c.depth, c.rate, len(m.trees), grown, loss, status)
            for c, m, grown, loss, status in zip(self.candidates, self.models, self.grown, self.losses, self.statuses)
        ]
        return df.sparkSession.createDataFrame(rows, "part int, max_depth int, rate double, trees int, grown int, loss double, status string")


def search(
    df: DataFrame, features: Sequence[str], candidates: Sequence[Candidate], flag: str = "s", *, loss: str = "logistic", validation: str | None = None,
    part: str | None = None, patience: int = 10, halve_at: Sequence[int] = (), max_bins: int = 64,
) -> Search:
    """Grow all candidates together. ``validation`` names a boolean column, whose rows stop but do not train."""
    label = flag_label(flag).cast("double")
    valid = F.lit(False) if validation is None else F.coalesce(F.col(validation), F.lit(False))
    rows = df.select(*dict.fromkeys(features), label.alias("__s"), valid.alias("__v"), F.coalesce(F.col(part) if part else F.lit(-1), F.lit(-1)).cast("int").alias("__p"))
    rows = stage(rows, "boosting-rows")
    binning = Binning.of(rows.where(~F.col("__v")), features, max_bins)
    counts = {r["__p"]: (r["n"], r["n1"]) for r in rows.where(~F.col("__v")).groupBy("__p").agg(F.count("*").alias("n"), F.sum("__s").alias("n1")).collect()}
    growing = [_Growing(i, c) for i, c in enumerate(candidates)]
    for c in growing:
        own = [v for k, v in counts.items() if c.settings.part in (None, k)]
        c.rows, c.first = sum(n for n, _ in own), LOSSES[loss].first
        c.start = LOSSES[loss].start(float(c.rows), float(sum(n1 for _, n1 in own)))
        c.begin()
    n, cuts = len(growing), [len(x) for x in binning.cuts]

    @F.arrow_udf("array<smallint>")
    def binned(values: pa.Array) -> pa.Array:
        bins = binning.bins(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(cuts)))
        return pa.ListArray.from_arrays(np.arange(0, bins.size + 1, len(cuts), dtype=np.int32), bins.ravel())

    f = F.array(*[F.lit(c.start) for c in growing])
    table = rows.select(binned(binning.column()).alias("bins"), F.col("__s").alias("s"), F.col("__p").alias("part"), F.col("__v").alias("valid"))
    alike = ["bins", "s", "part", "valid"]
    table = stage(table.groupBy(*alike).agg(F.count(F.lit(1)).alias("rows")).withColumn("stack", F.xxhash64(*alike)), "boosting-alike")
    size = table.count()
    if _Held.fits(size, len(cuts), n):
        table = _Held(table.toArrow(), growing, len(cuts))
    else:
        table = stage(table.repartition(max(1, math.ceil(size / _TASK_ROWS))).withColumn("f", f), "boosting-bins")
    while live := [c for c in growing if c.status == "growing"]:
        if not isinstance(table, _Held) and any(len(c.trees) - c.written >= _REFRESH for c in live):
            table = _applied(table, {c.number: c.trees[c.written :] for c in live}, n)
            for c in live:
                c.written = len(c.trees)
        found = _level(table, live, n, loss, cuts)
        for c in live:
            if c.open == [0]:
                c.losses.append(found[c.number, 1])
                # A draw may hold no row.
                empty = not found[c.number, 0].any() and (c.settings.row_share == 1 or not c.rows)
                if len(c.trees) >= c.settings.trees or empty:
                    c.status = "finished"
                elif len(c.trees) - c.best >= patience:
                    c.status = "stopped"
        _halve(live, halve_at)
        for c in live:
            if c.status != "growing":
                continue
            c.split(found[c.number, 0], cuts)
            if not c.open:
                c.trees.append(c.tree)
                c.begin()
    models = tuple(Ensemble(loss, binning, c.start, tuple(c.trees[: c.best])) for c in growing)
    return Search(models, tuple(candidates), tuple(float(c.losses[c.best]) if c.validated else float("inf") for c in growing), tuple(len(c.trees) for c in growing), tuple(c.status for c in growing))


def _halve(live: list[_Growing], halve_at: Sequence[int]) -> None:
    """Once all growing candidates of a part stand before the same rung, the worse half of them ends."""
    for part in {c.settings.part for c in live}:
        own = [c for c in live if c.settings.part == part and c.status == "growing"]
        for rung in halve_at:
            # Those that reach the rung first wait for none: all are compared by their best loss up to the rung.
            arrived = [c for c in own if c.validated and len(c.losses) > rung]
            if len(arrived) == len(own) > 1 and not all(c.rung >= rung for c in own):
                ranked = sorted(own, key=lambda c: (min(c.losses[: rung + 1]), c.number))
                for c in ranked[math.ceil(len(ranked) / 2) :]:
                    c.status = "halved"
                for c in own:
                    c.rung = rung
                own = [c for c in own if c.status == "growing"]


def fit_inverse(df: DataFrame, features: Sequence[str], flag: str = "s", *, validation: str | None = None, patience: int = 10, **settings) -> Ensemble:
    """One ensemble for the inverse propensity."""
    return search(df, features, [Candidate(**settings)], flag, loss="inverse", validation=validation, patience=patience).models[0]


def crossfit_inverse(
    df: DataFrame, features: Sequence[str], flag: str = "s", fold: str = "fold", out: str = "f", *, validation: str | None = None, patience: int = 10, **settings,
) -> DataFrame:
    """Both folds fitted in the same passes; each row gets the inverse propensity that the other fold's model gives it."""
    found = search(df, features, [Candidate(part=p, **settings) for p in (0, 1)], flag, loss="inverse", validation=validation, part=fold, patience=patience)
    halves = [found.best(p).score(df.where(F.col(fold) == 1 - p), out) for p in (0, 1)]
    return halves[0].unionByName(halves[1])
