"""Word and shingle hashes of whole text columns, computed on Arrow buffers with NumPy.

Words are the maximal runs outside ``\\x20\\x09-\\x0D`` of the UTF-8 bytes after lower-casing A-Z. All hashes are
64-bit and depend on the bytes alone, so any executor computes the same value.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes hashed at a time: bounds the working memory whatever the length of a text or of an Arrow batch.
PIECE = 1 << 20
# Two primes below 2**31 with a base each: sums of a byte times a power stay below 2**39, so that a piece of them fits 64 bits.
_FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 741_103_597))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo prime."""
    out = np.ones(n + 1, dtype=np.uint64)
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


@functools.cache
def _tables() -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Each prime with the powers of its base and of the base's inverse, for stretches of up to a piece."""
    return [(p, _powers(base, p, PIECE), _powers(pow(base, -1, p), p, PIECE)) for p, base in _FIELDS]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range, from their values modulo two primes and their length.

    Prime moduli: modulo a power of two, long words of two letters can be told apart by no base.
    """
    parts = []
    for prime, power, inverse in _tables():
        field, total, carry = np.uint64(prime), np.zeros(len(data) + 1, dtype=np.uint64), 0
        for at in range(0, len(data), PIECE):
            block = data[at : at + PIECE]
            # The power of a place counts from its block on; the block's first power takes part with the carry.
            lift = np.uint64(pow(int(power[1]), at, prime))
            sums = np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)]) % field
            total[at + 1 : at + 1 + len(block)] = (sums * lift + np.uint64(carry)) % field
            carry = int(total[at + len(block)])
        back = inverse[starts % PIECE]
        if len(data) > PIECE:
            leaps = _powers(pow(int(power[1]), -PIECE, prime), prime, len(data) // PIECE)
            back = back * leaps[starts // PIECE] % field
        parts.append((total[ends] + field - total[starts]) % field * back % field)
    joined = (parts[0] << np.uint64(31)) | parts[1]
    return mix(mix(joined) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_, starts


def row_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """The column in stretches of rows with about ``limit`` bytes of text, so that working memory does not follow the batch."""
    _, offsets = text_buffers(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield column.slice(at, stop - at)
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word in order, the row offsets into them, and each word's place and length in bytes."""
    parts, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    places, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + PIECE, end)
        if stop < end:
            # Cut between words: at the last space or row end of the piece.
            spaces = np.flatnonzero(_SPACE[data[at:stop]])
            row_end = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            stop = max(at + int(spaces[-1]) + 1 if len(spaces) else at, row_end)
        if stop <= at:
            # One word longer than a piece.
            row_end = int(offsets[np.searchsorted(offsets, at, "right")])
            stop = at + PIECE
            while stop < row_end and not _SPACE[data[stop : stop + PIECE]].any():
                stop += PIECE
            tail = np.flatnonzero(_SPACE[data[stop : min(stop + PIECE, row_end)]]) if stop < row_end else []
            stop = stop + int(tail[0]) if len(tail) else row_end
            digest = hashlib.blake2b(_LOWER[data[at:stop]].tobytes(), digest_size=8).digest()
            parts.append(np.frombuffer(digest, dtype=np.uint64))
            rows.append(np.array([np.searchsorted(offsets, at, "right") - 1]))
            places.append(np.array([at]))
            lengths.append(np.array([stop - at]))
        else:
            hashes, starts, ends = _piece(data[at:stop], offsets[(offsets > at) & (offsets < stop)] - at)
            parts.append(hashes)
            rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
            places.append(starts + at)
            lengths.append(ends - starts)
        at = stop
    row = np.concatenate(rows)
    return np.concatenate(parts), np.searchsorted(row, np.arange(len(offsets))), np.concatenate(places), np.concatenate(lengths)


def _piece(piece: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE[piece]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    # A row end parts words although no space stands there.
    inside = breaks[word[breaks]]
    first[inside] = True
    before = breaks[breaks > 0] - 1
    last[before[word[before]]] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return range_hashes(_LOWER[piece], starts, ends), starts, ends


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and the row offsets.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    joined = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        joined = joined * np.uint64(0x2545F4914F6CDD1D) + words[k : k + len(joined)]
    joined = mix(joined)
    parts, counts = [np.empty(0, np.uint64)], np.zeros(len(offsets), dtype=np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a >= width:
            part = np.unique(joined[a : b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * np.uint64(0x2545F4914F6CDD1D) + w
            part = mix(np.array([whole]))
        else:
            continue
        parts.append(part)
        counts[i + 1] = len(part)
    return np.concatenate(parts), np.cumsum(counts)
