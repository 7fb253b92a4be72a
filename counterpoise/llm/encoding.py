"""SentencePiece encoding by streaming Viterbi, and decoding, of whole text columns.

A text is read as blank-prefixed, cut into chunks at the boundaries that every path shares, and each distinct chunk of a
piece of the column is segmented once. Characters that are no piece are spelled by byte pieces, so that decoding gives back
every text byte for byte.

Defined results: null texts have null ids, empty texts none; texts of any length are read whole in bounded memory; a text
that holds the blank sign itself keeps it; ids outside the vocabulary fail; repeated rows get equal ids; other columns pass
through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.hashing import PIECE, range_hashes, text_buffers
from counterpoise.llm.pieces import VOCABULARY, Vocabulary, best_ids, load_vocabulary

# Distinct chunks whose ids a worker remembers; a chunk beyond them is segmented where it occurs.
_REMEMBERED = 300_000


class _Memory:
    """Ids of chunks seen before, by the chunks' bytes."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids, self.at, self.used = np.empty(1 << 16, np.int64), np.zeros(_REMEMBERED + 1, np.int64), 0

    def split(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which chunks are known, and the places of those."""
        place = np.fromiter((self.places.get(c, -1) for c in chunks), np.int64, len(chunks))
        return place >= 0, place[place >= 0]

    def add(self, chunks: list[bytes], ids: np.ndarray, at: np.ndarray) -> None:
        chunks = chunks[: _REMEMBERED - len(self.places)]
        if not chunks:
            return
        first, size = len(self.places), int(at[len(chunks)])
        self.at[first + 1 : first + 1 + len(chunks)] = self.used + at[1 : len(chunks) + 1]
        self.places.update(zip(chunks, range(first, first + len(chunks))))
        if self.used + size > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * size, np.int64)])
        self.ids[self.used : self.used + size] = ids[:size]
        self.used += size


_MEMORY: dict[int, _Memory] = {}


def _gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges ``starts, counts`` of ``ids``, one after the other."""
    ends = np.cumsum(counts)
    return ids[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _chunk_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places where every path has a boundary: text starts, blanks after other characters, before and after line ends."""
    blank, line = data == 32, data == 10
    first = np.zeros(len(data), dtype=bool)
    first[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    first[text_starts[text_starts < len(data)]] = True
    return np.flatnonzero(first)


def _encode_piece(vocabulary: Vocabulary, data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a stretch of texts, and the offsets of its chunks' ids; ``text_starts`` begin with 0."""
    starts = _chunk_starts(data, text_starts)
    ends = np.append(starts[1:], len(data))
    body = data.tobytes()
    distinct, once, which = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    # Chunks of one hash must be equal byte for byte; else they are told apart by their bytes.
    same = (ends - starts)[once][which] == ends - starts
    if not same.all() or (_gathered(data, starts[once][which], ends - starts) != data).any():
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(body[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
        once = np.unique(which, return_index=True)[1]
    memory = _MEMORY.setdefault(vocabulary.mark, _Memory())
    chunks = [body[a:b] for a, b in zip(starts[once].tolist(), ends[once].tolist())]
    known_, place = memory.split(chunks)
    fresh = [c for c, seen in zip(chunks, known_.tolist()) if not seen]
    ids, at = best_ids(vocabulary, [c.decode() for c in fresh])
    begin, counts = np.empty(len(once), np.int64), np.empty(len(once), np.int64)
    begin[known_], counts[known_] = memory.at[place], memory.at[place + 1] - memory.at[place]
    begin[~known_], counts[~known_] = memory.used + at[:-1], np.diff(at)
    pool = np.concatenate([memory.ids[: memory.used], ids])
    memory.add(fresh, ids, at)
    counts = counts[which]
    out = _gathered(pool, begin[which], counts)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    # Ids before each text.
    return out, offsets[np.searchsorted(starts, text_starts)]


def encode_texts(vocabulary: Vocabulary, column: pa.Array) -> pa.Array:
    """Ids of each text, as lists of ints."""
    data, offsets = text_buffers(column)
    base = int(offsets[0])
    offsets = offsets - base
    data = data[base : base + int(offsets[-1])]
    some = np.flatnonzero(np.diff(offsets))
    # Every text that is not empty gets the leading blank.
    data = np.insert(data, offsets[some], 32)
    marks = offsets[some] + np.arange(len(some))
    parts, lengths = [np.empty(0, np.int32)], np.zeros(len(column), dtype=np.int64)
    at = 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):
            cuts = _chunk_starts(data[at:stop], marks[(marks >= at) & (marks < stop)] - at)
            if len(cuts) and cuts[-1] > 0:
                stop = at + int(cuts[-1])
            else:
                # One chunk longer than a piece: up to its end.
                while stop < len(data):
                    further = min(stop + PIECE, len(data))
                    cuts = _chunk_starts(data[stop - 1 : further], marks[(marks >= stop) & (marks < further)] - stop + 1)
                    cuts = cuts[cuts > 0]
                    stop = stop - 1 + int(cuts[0]) if len(cuts) else further
                    if len(cuts):
                        break
        inside = np.flatnonzero((marks >= at) & (marks < stop))
        starts = marks[inside] - at
        owners = some[inside]
        if not len(starts) or starts[0] > 0:
            # The stretch goes on with a text that began before it.
            starts = np.concatenate([[0], starts])
            owners = np.concatenate([[some[np.searchsorted(marks, at, "right") - 1]], owners])
        ids, before = _encode_piece(vocabulary, data[at:stop], starts)
        parts.append(ids.astype(np.int32))
        np.add.at(lengths, owners, np.diff(np.append(before, len(ids))))
        at = stop
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = pa.array(column.is_null().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)), mask=mask)


def decode_ids(vocabulary: Vocabulary, column: pa.Array) -> list[bytes | None]:
    """Bytes of each id list, without the leading blank."""
    surfaces = vocabulary.surfaces
    out: list[bytes | None] = []
    for ids in column:
        out.append(b"".join([surfaces[i] for i in ids.values.to_numpy().tolist()])[1:] if ids.is_valid else None)
    return out


def _ready(path: str) -> Vocabulary:
    vocabulary = load_vocabulary(path)
    # Tables are made once, here, and travel with the function.
    _ = vocabulary.table, vocabulary.byte_ids, vocabulary.longest, vocabulary.surfaces, vocabulary.mark
    return vocabulary


def encode(text: str | Column, path: str = VOCABULARY) -> Column:
    """array<int> of the ids of a text column."""
    vocabulary = _ready(path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(column: pa.Array) -> pa.Array:
        return encode_texts(vocabulary, column)

    return encoded(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, path: str = VOCABULARY) -> Column:
    """Text of an id column."""
    vocabulary = _ready(path)

    @F.arrow_udf(T.StringType())
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array(decode_ids(vocabulary, column), pa.binary()).cast(pa.string())

    return decoded(F.col(ids) if isinstance(ids, str) else ids)


def encode_checked(text: str | Column, path: str = VOCABULARY) -> Column:
    """``ids``, and ``exact``: whether decoding them gives the text back byte for byte (null for a null text)."""
    vocabulary = _ready(path)

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]))
    def checked(column: pa.Array) -> pa.Array:
        ids = encode_texts(vocabulary, column)
        back = decode_ids(vocabulary, ids)
        bodies = column.cast(pa.large_binary())
        exact = pa.array([None if b is None else b == a.as_py() for a, b in zip(bodies, back)], pa.bool_())
        return pa.StructArray.from_arrays([ids, exact], names=["ids", "exact"])

    return checked(F.col(text) if isinstance(text, str) else text)
