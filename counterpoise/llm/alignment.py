"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which tokens of another.

Two tokenizers cut one byte string. Their token-byte incidence matrices A and B are sparse matrices in rows (``Csr``), and
Gustavson's row products do the work:

* A times B transposed gives the overlap links, with the number of shared bytes as values. Where no token of the one side
  links two neighbours of the other, both end at one place, and a group ends.
* The incidence of token ids and groups, times that of groups and the other side's ids, gives the shared-group links of each
  pair of ids with their number. Pairs are summed inside the product, so memory follows the distinct pairs of a text.

``alignments`` returns tokens, overlap links and groups of every text. ``alignment_digest`` returns counts and, for each text,
how common its links are: a link's count is the number of rows whose text holds its pair of ids. The pairs of a text are
written once with its counts; the corpus counts are summed per task before they are shuffled; the most frequent pairs (at most
``head``) are looked up inside the scan, all rarer ones by a join, where no key has more rows than a rare pair has documents.

Texts are cut for encoding only between a letter or digit and a single blank, where both tokenizers have a boundary on every
path; a text without such a place for long is encoded in one go.

Defined results: null and empty texts, and those that either tokenizer does not give back byte for byte, have no tokens;
texts of any length are read whole; every row is a document of its own, also where a row or a key repeats or is null; ties for
an id's highest count all count as best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.hashing import row_slices
from counterpoise.session import stage

TOKENIZERS = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Terms of a row product held at a time, bytes of text encoded at a time, characters of a text encoded in one call.
_TERMS, _SLICE, _CALL = 1 << 19, 1 << 20, 1 << 17
# Pairs counted in a task before they are passed on, and pairs looked up without a shuffle.
_COUNTED, HEAD = 1 << 20, 1 << 18
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: row i holds ``values`` in the columns ``indices`` of ``indptr[i]:indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @classmethod
    def of_ranges(cls, lengths: np.ndarray) -> Csr:
        """Row i covers the next ``lengths[i]`` columns."""
        indptr = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        size = int(indptr[-1])
        return cls(indptr, np.arange(size), np.ones(size, np.int64), size)

    @classmethod
    def of_places(cls, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> Csr:
        """The matrix that counts the given places."""
        keys, counts = np.unique(rows * n_columns + columns, return_counts=True)
        return cls(np.searchsorted(keys, np.arange(n_rows + 1) * n_columns), keys % n_columns, counts, n_columns)

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), self.row_numbers()[order], self.values[order], self.rows)

    def product(self, other: Csr) -> Csr:
        """Row by row: row i is the sum of ``other``'s rows k, each times the value at (i, k)."""
        lengths = np.diff(other.indptr)
        terms = lengths[self.indices]
        # Terms before each row; rows are taken together up to a bounded number of terms.
        before = np.concatenate([[0], np.cumsum(terms)])[self.indptr]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < self.rows:
            stop = max(at + 1, int(np.searchsorted(before, before[at] + _TERMS, "right")) - 1)
            inside = slice(self.indptr[at], self.indptr[stop])
            count = terms[inside]
            ends = np.cumsum(count)
            place = np.repeat(other.indptr[self.indices[inside]] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
            row = np.repeat(np.repeat(np.arange(at, stop), np.diff(self.indptr[at : stop + 1])), count)
            parts.append(_summed(row * other.columns + other.indices[place], np.repeat(self.values[inside], count) * other.values[place]))
            at = stop
        keys = np.concatenate([np.empty(0, np.int64), *[k for k, _ in parts]])
        values = np.concatenate([np.empty(0, np.int64), *[v for _, v in parts]])
        columns = max(other.columns, 1)
        return Csr(np.searchsorted(keys, np.arange(self.rows + 1) * columns), keys % columns, values, other.columns)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values, starts)


class Tokenizers:
    """Both tokenizers and the bytes of their tokens. Loaded in each worker from files that every machine has."""

    def __init__(self, folder: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(f"{folder}/{BYTE_FILE}")
        # Special tokens' strings are plain text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_FILE}")
        self.a_bytes, self.b_bytes = self._byte_level(), self._pieces()
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        names = [f"{i}{end}".encode() for end in ",|" for i in range(len(self.a_bytes))]
        names += [f"{i}{end}".encode() for end in ",;" for i in range(len(self.b_bytes))]
        self.names = _objects(names)

    def _byte_level(self) -> np.ndarray:
        # Bytes that print stand for themselves; the others, in order, for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        out = [b""] * self.a.get_vocab_size(True)
        for token, i in self.a.get_vocab(True).items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return _objects(out)

    def _pieces(self) -> np.ndarray:
        out = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        return _objects(out)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text, none where the ids do not give back a blank and the text."""
        calls, owner = [], []
        for i, text in enumerate(texts):
            for part in _parts(text):
                calls.append(part)
                owner.append(i)
        a = [np.array(e.ids, dtype=np.int64) for e in self.a.encode_batch_fast([f" {c}" for c in calls], add_special_tokens=False)]
        b = [np.array(ids, dtype=np.int64) for ids in self.b.encode(calls, num_threads=1)] if calls else []
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        out: tuple[list, list] = ([], [])
        none = np.empty(0, np.int64)
        for i, text in enumerate(texts):
            own_a, own_b = (np.concatenate([none, *x[bounds[i] : bounds[i + 1]]]) for x in (a, b))
            whole = f" {text}".encode()
            same = b"".join(self.a_bytes[own_a].tolist()) == whole and b"".join(self.b_bytes[own_b].tolist()) == whole
            out[0].append(own_a if same else none)
            out[1].append(own_b if same else none)
        return out


def _objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _parts(text: str) -> Iterator[str]:
    """The text cut at single blanks between words, the blank going: both encoders put one before each part."""
    at = 0
    while text:
        cut = _CUT.search(text, at + _CALL) if len(text) - at > _CALL else None
        yield text[at : cut.start()] if cut else text[at:]
        if not cut:
            return
        at = cut.end()


@functools.lru_cache(maxsize=2)
def loaded(folder: str) -> Tokenizers:
    return Tokenizers(folder)


@dataclass(frozen=True)
class Aligned:
    """Some texts aligned as one byte string: ids, text bounds, overlap links and the group of every token."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    overlaps: Csr
    a_group: np.ndarray
    b_group: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.a_group[-1]) + 1 if len(self.a_group) else 0

    def groups_per_text(self) -> np.ndarray:
        bounds = np.append(self.a_group, self.groups)[self.a_at]
        return np.diff(bounds)

    def id_links(self, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shared-group links by pair of ids: bounds per text, ids of both, and the links of each pair."""
        text = np.repeat(np.arange(len(self.a_at) - 1), np.diff(self.a_at))
        width = int(self.a.max(initial=0)) + 1
        keys, row = np.unique(text * width + self.a, return_inverse=True)
        by_id = Csr.of_places(row, self.a_group, len(keys), max(self.groups, 1))
        by_group = Csr.of_places(self.b_group, self.b, max(self.groups, 1), n_b)
        links = by_id.product(by_group)
        bounds = links.indptr[np.searchsorted(keys, np.arange(len(self.a_at)) * width)]
        return bounds, np.repeat(keys % width, np.diff(links.indptr)), links.indices, links.values

    def digests(self, names: np.ndarray, n_a: int, n_b: int) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` per text, empty without tokens."""
        groups = np.arange(self.groups)
        a_from, b_from = np.searchsorted(self.a_group, groups), np.searchsorted(self.b_group, groups)
        ends_a = np.append(self.a_group[1:] != self.a_group[:-1], True)[: len(self.a)]
        ends_b = np.append(self.b_group[1:] != self.b_group[:-1], True)[: len(self.b)]
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        codes[np.arange(len(self.a)) + b_from[self.a_group]] = self.a + n_a * ends_a
        codes[np.arange(len(self.b)) + np.append(a_from, len(self.a))[self.b_group + 1]] = 2 * n_a + self.b + n_b * ends_b
        out, bounds = [], (self.a_at + self.b_at).tolist()
        for at, stop in zip(bounds[:-1], bounds[1:]):
            if at == stop:
                out.append("")
                continue
            digest = hashlib.sha256()
            for i in range(at, stop, _TERMS):
                part = b"".join(names[codes[i : min(i + _TERMS, stop)]].tolist())
                digest.update(part if i + _TERMS < stop else part[:-1])
            out.append(digest.hexdigest())
        return out


def align(tokenizers: Tokenizers, texts: list[str | None]) -> Aligned:
    a, b = tokenizers.encode([t or "" for t in texts])
    none = np.empty(0, np.int64)
    a_at, b_at = (np.concatenate([[0], np.cumsum([len(x) for x in side], dtype=np.int64)]) for side in (a, b))
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    overlaps = Csr.of_ranges(tokenizers.a_lengths[a]).product(Csr.of_ranges(tokenizers.b_lengths[b]).transposed())
    # A token begins a group unless the other side's first token that it meets also meets the token before.
    first, last = overlaps.indices[overlaps.indptr[:-1]], overlaps.indices[overlaps.indptr[1:] - 1]
    begins = np.ones(len(a), dtype=np.int64)
    begins[1:] = first[1:] != last[:-1]
    a_group = np.cumsum(begins) - 1
    b_group = np.empty(len(b), dtype=np.int64)
    b_group[overlaps.indices] = a_group[overlaps.row_numbers()]
    return Aligned(a, b, a_at, b_at, overlaps, a_group, b_group)


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def alignments(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Per row: key, ids of both tokenizers, the group of every token (from 0), and the overlap links as token places and bytes."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in row_slices(batch.column(1), _SLICE):
                x = align(loaded(folder), part.to_pylist())
                zero = np.append(x.a_group, 0)[x.a_at[:-1]]
                a_text, b_text = (np.repeat(np.arange(len(part)), np.diff(side)) for side in (x.a_at, x.b_at))
                rows = x.overlaps.row_numbers()
                links = pa.StructArray.from_arrays([
                    pa.array(rows - x.a_at[a_text[rows]], pa.int32()), pa.array(x.overlaps.indices - x.b_at[a_text[rows]], pa.int32()),
                    pa.array(x.overlaps.values, pa.int32()),
                ], names=["a", "b", "bytes"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), _lists(x.a, x.a_at, pa.int32()), _lists(x.b, x.b_at, pa.int32()),
                    _lists(x.a_group - zero[a_text], x.a_at, pa.int32()), _lists(x.b_group - zero[b_text], x.b_at, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(x.overlaps.indptr[x.a_at].astype(np.int32)), links),
                ], names=["key", "a_ids", "b_ids", "a_group", "b_group", "links"])
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>, links array<struct<a:int,b:int,bytes:int>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(aligned, schema).withColumnRenamed("key", key)


def _measured(docs: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """Per row its number, key, counts and digest, and its pairs of ids with their links."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(folder)
        n_a, n_b = len(both.a_bytes), len(both.b_bytes)
        for batch in batches:
            at = 0
            for part in row_slices(batch.column(2), _SLICE):
                x = align(both, part.to_pylist())
                bounds, a, b, n = x.id_links(n_b)
                links = np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(np.diff(x.a_at)), pa.array(np.diff(x.b_at)),
                    pa.array(x.groups_per_text()), pa.array(links), pa.array(x.digests(both.names, n_a, n_b), pa.string()),
                    _lists(a, bounds, pa.int32()), _lists(b, bounds, pa.int32()), _lists(n, bounds, pa.int64()),
                ], names=["r", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"])
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"r long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>"
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(measured, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy().astype(np.int64), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, count, best``: rows that hold each pair of ids, and whether it is its a's highest count. Summed per task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            columns = [pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(counts)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "count"])

        for batch in batches:
            new = (_flat(batch.column(0))[0] << 32) | _flat(batch.column(1))[0]
            for at in range(0, len(new), _TERMS):
                more, n = np.unique(new[at : at + _TERMS], return_counts=True)
                merged = np.concatenate([keys, more])
                order = np.argsort(merged, kind="stable")
                keys, counts = _summed(merged[order], np.concatenate([counts, n])[order])
                if len(keys) > _COUNTED:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out()

    counts = rows.select("a", "b").mapInArrow(counted, "a int, b int, count long").groupBy("a", "b").agg(F.sum("count").alias("count"))
    counts = stage(counts, "alignment-pairs")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return stage(counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best")), "alignment-counts")


def _split(counts: DataFrame, head: int) -> tuple[DataFrame, DataFrame, int]:
    """The most frequent pairs, at most ``head`` of them, the others, and how many those are."""
    power = F.floor(F.log2("count")).cast("int")
    sizes = sorted(counts.groupBy(power.alias("p")).agg(F.count("*")).collect(), reverse=True)
    least, held = 1 << 62, 0
    for p, n in sizes:
        if held + n > head:
            break
        least, held = 1 << p, held + n
    return counts.where(F.col("count") >= least), counts.where(F.col("count") < least), sum(n for _, n in sizes) - held


def alignment_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, head: int = HEAD) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    rows = stage(_measured(docs, key, text, folder), "alignment-rows")
    common, rare, n_rare = _split(pair_counts(rows), head)
    known = common.toArrow()
    keys = (known["a"].to_numpy().astype(np.int64) << 32) | known["b"].to_numpy()
    order = np.argsort(keys)
    # A sentinel ends the table, so that every search has a place.
    keys = np.append(keys[order], np.iinfo(np.int64).max)
    count, best = (np.append(known[c].to_numpy().astype(np.int64)[order], 0) for c in ("count", "best"))

    def looked_up(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (a, bounds), (b, _), (n, _) = (_flat(batch.column(i)) for i in range(at, at + 3))
        wanted = (a << 32) | b
        place = np.searchsorted(keys, wanted)
        return wanted, bounds, n, place, keys[place] == wanted

    plain = ["r", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds, n, place, found = looked_up(batch, len(plain))
            sums = [np.diff(np.concatenate([[0], np.cumsum(np.where(found, n * table[place], 0))])[bounds]) for table in (best, count)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(plain))], *map(pa.array, sums)], names=[*plain, "n_best", "count_sum"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, bounds, n, _, found = looked_up(batch, 1)
            r = np.repeat(batch.column(0).to_numpy(), np.diff(bounds))[~found]
            wanted = wanted[~found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r), pa.array(wanted >> 32, pa.int32()), pa.array(wanted & 0xFFFFFFFF, pa.int32()), pa.array(n[~found])], names=["r", "a", "b", "n"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"r long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = rows.select(*plain, "a", "b", "n").mapInArrow(scored, schema)
    if n_rare:
        more = rows.select("r", "a", "b", "n").mapInArrow(left, "r long, a int, b int, n long").join(rare, ["a", "b"])
        more = more.groupBy("r").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("m_best"), F.sum(F.col("n") * F.col("count")).alias("m_sum"))
        out = out.join(more, "r", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("m_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("m_sum", F.lit(0)),
        })
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
