"""Regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled covariance and its mean variance; a document's score is
the logistic of the difference of the two log densities, whose Mahalanobis terms use Cholesky factors computed once.
Only the text feeds a score.

Defined results: a null text counts as empty and an empty text is scored like any other; a document with several labels
counts once per label; null labels are ignored; without training rows of both classes every score is the share of good
labels (0.5 when there is none). Extra columns pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.hashing import row_slices, text_buffers, word_hashes
from counterpoise.session import stage

FEATURES = (
    "words", "word_length", "length_spread", "upper", "symbols", "marks", "digits", "repeats", "distinct", "short_words", "line_words",
)
_PSEUDO_WORDS = 12.0
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "symbols": b"#$%&*+/<=>@[\\]^_`{|}~",
    "marks": b"!?\"'():;",
    "digits": b"0123456789",
}


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text, over the whole text."""
    return np.concatenate([np.empty((0, len(FEATURES))), *[_slice_statistics(part) for part in row_slices(column)]])


def _slice_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(column)
    hashes, at, places, lengths = word_hashes(data, offsets)
    # Pseudo-counts keep the shares of very short texts from being all noise.
    size = np.diff(offsets) + 60.0
    n = np.diff(at).astype(float)
    some = n + _PSEUDO_WORDS
    mean = (_row_sums(lengths, at) + 5.0 * _PSEUDO_WORDS) / some
    spread = np.sqrt((_row_sums((lengths - 5.0) ** 2, at) + 9.0 * _PSEUDO_WORDS) / some)
    share = {}
    base = int(offsets[0])
    for name, members in _CLASSES.items():
        table = np.zeros(256, dtype=np.uint8)
        table[list(members)] = 1
        share[name] = _row_sums(table[data[base : int(offsets[-1])]], offsets - base) / size
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = hashes[1:] == hashes[:-1]
        same[at[:-1][at[:-1] < len(hashes)]] = 0
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], dtype=float)
    newline = np.flatnonzero(data[base : int(offsets[-1])] == 10) + base
    lines = np.diff(np.searchsorted(newline, offsets)) + 1.0
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), np.sqrt(share["upper"]), np.sqrt(share["symbols"]), np.sqrt(share["marks"]),
        np.sqrt(share["digits"]), np.sqrt(_row_sums(same, at) / some), np.log1p(distinct + _PSEUDO_WORDS) / np.log1p(some),
        np.sqrt((_row_sums(lengths <= 3, at) + 0.4 * _PSEUDO_WORDS) / some), np.log1p(n / lines),
    ])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pa.Array) -> pa.Array:
    values = statistics(text)
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())


@dataclass(frozen=True)
class Discriminant:
    """Class log priors, means, Cholesky factors of the shrunk covariances and their log determinants."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability that the label is 1."""
        if self.means is None:
            return np.full(len(values), self.prior)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            solved = np.linalg.solve(factor, (values - mean).T)
            logs.append(constant - 0.5 * (solved**2).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def score_column(self, text: str | Column) -> Column:
        """Score of a text column."""

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            return pa.array(self.score(statistics(column)))

        return scored(text)


def held_out(key: str | Column) -> Column:
    """Rows that labels are never learned from: crc32 of the key as text, modulo 3, is 1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(statistics_: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit from all labelled rows that are not held out; one aggregate row per class reaches the driver.

    ``shrink`` pulls each class covariance towards the pooled one, ``ridge`` towards the pooled mean variance.
    """
    d = len(FEATURES)
    f = [F.col("statistics")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    labels = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    rows = (
        statistics_.select(F.col(key).alias("k"), "statistics").join(labels, "k").groupBy("y")
        .agg(F.count("*"), *[F.sum(x) for x in f], *[F.sum(f[i] * f[j]) for i, j in pairs]).collect()
    )
    moments = {}
    for row in rows:
        n, first, second = row[1], np.array(row[2 : 2 + d], dtype=float), np.zeros((d, d))
        for (i, j), v in zip(pairs, row[2 + d :]):
            second[i, j] = second[j, i] = v
        mean = first / n
        moments[row[0]] = (n, mean, second / n - np.outer(mean, mean))
    total = sum(m[0] for m in moments.values())
    if len(moments) < 2:
        return Discriminant(prior=float(1 in moments) if total else 0.5)
    pooled = sum(n * cov for n, _, cov in moments.values()) / total
    target = np.diag(np.full(d, max(np.trace(pooled) / d, 1e-9)))
    means, factors, constants = [], [], []
    for y in (0, 1):
        n, mean, cov = moments[y]
        factor = np.linalg.cholesky((1 - shrink - ridge) * cov + shrink * pooled + ridge * target)
        means.append(mean)
        factors.append(factor)
        constants.append(math.log(n / total) - float(np.log(np.diag(factor)).sum()))
    return Discriminant(moments[1][0] / total, np.array(means), np.array(factors), np.array(constants))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score of every document. The statistics are computed once and written, then fitted and scored."""
    table = stage(docs.select(F.col(key), _statistics(F.col(text)).alias("statistics")), "quality")
    model = fit(table, labels, key)

    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(FEATURES))
        return pa.array(model.score(flat))

    return table.select(key, scored("statistics").alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Documents scored at least ``threshold``, with their own columns. No text is shuffled."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(key)).select(F.col(key).alias("k")).distinct()
    model = fit(labelled.join(known, "k", "left_semi").select(F.col("k").alias(key), _statistics("t").alias("statistics")), labels, key)
    return docs.where(model.score_column(F.col(text)) >= threshold)
