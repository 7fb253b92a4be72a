"""Quality rules: base statistics of a text, and its hashed n-gram log-likelihood ratio between a trusted and the raw corpus.

Single words and pairs of words are hashed into ``buckets``. Two multinomials over the buckets, with ``alpha`` added to every
count, are estimated from all documents (raw) and from the trusted ones; a document's score is the mean over its n-grams of
log(trusted / raw), so its length does not count. A document is kept when its words suffice, few of them stand in repeated
windows, and its score reaches ``threshold``: a fixed rule, no sampling.

Raw counts cover all documents, in one pass: each task sums its buckets, and what reaches the driver are two numbers a bucket.
The trusted counts cover all trusted documents, and no text is shuffled to find them, however many keys there are. The same pass
counts the documents whose hashed key is that of some trusted one, by a table of bits of bounded size; keys that only share a
hash are found by a join of keys alone, and what their documents had added is taken off again. ``trusted_rows`` bounds the
trusted keys to a sample where a caller wants one.

Defined results: a null text counts as empty; an empty text scores 0 and is not kept; a key is trusted when any of its labels
is 1, and each of its rows counts; null labels are ignored; without trusted or without any documents every ratio is that of
``alpha`` alone; texts of any length are read whole; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.session import stage

BUCKETS, ALPHA, THRESHOLD = 1 << 14, 1.0, -0.06
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
_WORD, _SPACE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")
_MULTIPLIER, _PRIME = 1_000_003, (1 << 31) - 1
# Characters split at a time; words and characters that a worker remembers between documents.
_SLICE, _REMEMBERED, _CHARACTERS = 1 << 20, 1 << 20, 1 << 25
# Bits of the table of hashed trusted keys: about this many for each, up to 8 MB; a fuller table only has more to take off.
_BITS_PER_KEY, _MOST_BITS = 16, 1 << 26
_SCHEMA = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_grams:long,score:double>"
)


class _Words(dict):
    """Number of every word met, in order of appearance, and the hash of each."""

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.characters = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(int(hashlib.md5(word.encode()).hexdigest()[:7], 16))
        self.characters += len(word)
        return number

    @property
    def full(self) -> bool:
        return len(self.hashes) > _REMEMBERED or self.characters > _CHARACTERS

    def numbers(self, text: str) -> np.ndarray:
        """Numbers of the words of a text, in order."""
        parts, at = [np.empty(0, np.int64)], 0
        while at < len(text):
            end = _SPACE.search(text, at + _SLICE)
            stop = end.start() if end else len(text)
            words = _WORD.findall(text, at, stop)
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            at = stop
        return np.concatenate(parts)


def _hashed(words: _Words, numbers: np.ndarray) -> np.ndarray:
    """Hash of each word in order. Only the document's own words are turned into an array."""
    distinct, place = np.unique(numbers, return_inverse=True)
    return np.array([words.hashes[i] for i in distinct.tolist()], dtype=np.int64)[place]


def grams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all words and of all pairs of neighbours."""
    return np.concatenate([hashes % buckets, (hashes[:-1] * _MULTIPLIER + hashes[1:]) % _PRIME % buckets])


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside windows of three that occur at least twice."""
    if len(numbers) < 4:
        return 0
    distinct, x = np.unique(numbers, return_inverse=True)
    window = x[:-2] * len(distinct) + x[1:-1]
    if len(distinct) ** 3 >= 1 << 62:
        window = np.unique(window, return_inverse=True)[1]
    _, place, count = np.unique(window * len(distinct) + x[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    inside = np.zeros(len(numbers), dtype=bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


@dataclass(frozen=True)
class Ratios:
    """log(trusted / raw) of every bucket."""

    logs: np.ndarray

    @classmethod
    def of_counts(cls, raw: np.ndarray, trusted: np.ndarray, alpha: float) -> Ratios:
        share = lambda c: np.log((c + alpha) / (c.sum() + alpha * len(c)))
        return cls(share(trusted.astype(np.float64)) - share(raw.astype(np.float64)))

    def measure(self, text: str | Column) -> Column:
        """The base statistics of a text column and its score, as a struct."""
        logs = self.logs
        words = _Words()

        @F.arrow_udf(_SCHEMA)
        def measured(column: pa.Array) -> pa.Array:
            nonlocal words
            rows: list[tuple] = []
            for value in column:
                content = value.as_py() or ""
                numbers = words.numbers(content)
                found = grams(_hashed(words, numbers), len(logs))
                blanks = sum(map(content.count, " \t\n\v\f\r"))
                rows.append((
                    len(numbers), len(content) - blanks, sum(map(content.count, SYMBOLS)), repeated_lines(content), repeated_words(numbers),
                    len(found), float(logs[found].mean()) if len(found) else 0.0,
                ))
                if words.full:
                    words = _Words()
            kinds = [pa.int64()] * 6 + [pa.float64()]
            names = [part.split(":")[0] for part in _SCHEMA[7:-1].split(",")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        return measured(F.col(text) if isinstance(text, str) else text)


class _Keys:
    """A table of bits, one set for each hash that a trusted key has."""

    def __init__(self, trusted: DataFrame) -> None:
        self.size = min(_MOST_BITS, max(64, 1 << (_BITS_PER_KEY * trusted.count()).bit_length()))
        bits = F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")
        found = trusted.select(self.place("k").alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(bits).toArrow()
        self.words = np.zeros(self.size // 64, dtype=np.int64)
        self.words[found["word"].to_numpy()] = found["bits"].to_numpy()

    def place(self, key: str) -> Column:
        """The bit of a key; -1 for none."""
        hashed = F.pmod(F.xxhash64(F.lit("trusted key"), key), F.lit(self.size).cast("long"))
        return F.when(F.col(key).isNotNull(), hashed).otherwise(F.lit(-1).cast("long"))

    def held(self, places: np.ndarray) -> np.ndarray:
        return (places >= 0) & ((self.words[np.maximum(places, 0) >> 6] >> (places & 63)) & 1).astype(bool)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = BUCKETS, alpha: float = ALPHA,
    trusted_rows: int | None = None,
) -> Ratios:
    """Count the n-grams of all documents and of those labelled 1; with ``trusted_rows`` of about that many keys of the smallest hashes."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    trusted = labels.where(F.col(label) == 1).select(F.col(key).try_cast(docs.schema[key].dataType).alias("k")).where("k IS NOT NULL").distinct()
    trusted = stage(trusted, "trusted-keys")
    share = 1.0 if trusted_rows is None else trusted_rows / max(trusted.count(), 1)
    if share < 1:
        trusted = trusted.where(F.pmod(F.xxhash64(F.lit("trusted"), "k"), F.lit(1 << 32)) < int(share * (1 << 32)))
    keys = _Keys(trusted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), dtype=np.int64)
        words = _Words()
        for batch in batches:
            for value, held in zip(batch.column(0), keys.held(batch.column(1).to_numpy()).tolist()):
                found = np.bincount(grams(_hashed(words, words.numbers(value.as_py() or "")), buckets), minlength=buckets)
                counts[0] += found
                if held:
                    counts[1] += found
                if words.full:
                    words = _Words()
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(c[some]) for c in counts]], names=["bucket", "raw", "held"])

    def summed(rows: DataFrame) -> np.ndarray:
        sums = rows.select("t", keys.place("k").alias("place")).mapInArrow(counted, "bucket int, raw long, held long")
        found = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("held").alias("held")).toArrow()
        counts = np.zeros((2, buckets), dtype=np.int64)
        counts[:, found["bucket"].to_numpy()] = found["raw"].to_numpy(), found["held"].to_numpy()
        return counts

    @F.arrow_udf("boolean")
    def held(places: pa.Array) -> pa.Array:
        return pa.array(keys.held(places.to_numpy(zero_copy_only=False)))

    raw, good = summed(rows)
    # Keys that share the hash of a trusted one without being trusted.
    others = stage(rows.select("k").where(held(keys.place("k"))).distinct().join(trusted, "k", "left_anti"), "other-keys")
    if not others.isEmpty():
        good = good - summed(rows.join(others, "k"))[1]
    return Ratios.of_counts(raw, good, alpha)


def judged(docs: DataFrame, ratios: Ratios, text: str = "text", threshold: float = THRESHOLD, into: str = "rules") -> DataFrame:
    """Adds a struct ``into``: the statistics, the score, ``base_failed`` and ``kept``."""
    out = docs.withColumn(into, ratios.measure(text))
    at = lambda name: F.col(f"{into}.{name}")
    failed = (at("n_words") < MIN_WORDS) | (100 * at("n_repeat_words") > MAX_REPEATED * at("n_words"))
    return out.withColumn(into, F.col(into).withField("base_failed", failed).withField("kept", ~failed & (at("score") >= threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs, fit(docs, labels, key, text), text, threshold, "__rules").where("__rules.kept").drop("__rules")
