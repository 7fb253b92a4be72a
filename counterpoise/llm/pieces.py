"""A SentencePiece vocabulary as a lattice: best segmentations, sums over all segmentations, and their texts.

Chunks are cut where every path must have a boundary: before a run of blanks that follows another character, and around
line ends, since no piece reaches across (checked when the vocabulary is read). Short chunks are taken in lockstep, many of
equal length at once; longer ones by a streaming pass that keeps scores for the longest piece only and commits pieces as
soon as all surviving paths agree on a boundary. Both follow the same recurrence.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from counterpoise.llm.hashing import mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
# A literal blank sign of a text is no blank: it is kept apart and spelled in bytes.
_LITERAL = 0x110000
# Longest chunk taken in lockstep, and characters taken at a time: a lattice holds some 30 numbers for each.
LOCKSTEP, _CHARACTERS = 48, 100_000
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with a log probability each; ``kind``: 0 ordinary, 1 byte, 2 control."""

    pieces: tuple[str, ...]
    logs: np.ndarray
    kind: np.ndarray

    def with_logs(self, logs: np.ndarray) -> Vocabulary:
        return Vocabulary(self.pieces, logs, self.kind)

    @functools.cached_property
    def mark(self) -> bytes:
        """Digest of the pieces and their probabilities."""
        return hashlib.sha256("\n".join(self.pieces).encode() + self.logs.tobytes()).digest()

    @functools.cached_property
    def byte_ids(self) -> np.ndarray:
        out = np.zeros(256, dtype=np.int64)
        for i in np.flatnonzero(self.kind == 1):
            out[int(self.pieces[i][1:-1], 16)] = i
        return out

    @functools.cached_property
    def longest(self) -> int:
        return max(len(p) for p, k in zip(self.pieces, self.kind) if k == 0)

    @functools.cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.kind[i] == 0}

    @functools.cached_property
    def end_id(self) -> int:
        return self.pieces.index("</s>")

    @functools.cached_property
    def surfaces(self) -> tuple[bytes, ...]:
        """Bytes that each id stands for."""
        return tuple(
            bytes([int(p[1:-1], 16)]) if k == 1 else b"" if k == 2 else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kind)
        )

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open-addressing hash table of the ordinary pieces: hashes, ids, and the longest probe."""
        bits = max(4, int(np.ceil(np.log2(len(self.pieces) * 4))))
        keys, ids, most = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int64), 0
        sizes: dict[int, list[str]] = {}
        for piece in self.ids:
            sizes.setdefault(len(piece), []).append(piece)
        for size, group in sizes.items():
            codes = np.frombuffer("".join(group).encode("utf-32-le"), dtype=np.uint32).reshape(len(group), size)
            for piece, key in zip(group, _spans(_prefixes(codes), size)[:, 0].tolist()):
                at, steps = key >> (64 - bits), 0
                while ids[at] >= 0:
                    at, steps = (at + 1) % len(ids), steps + 1
                keys[at], ids[at] = key, self.ids[piece]
                most = max(most, steps)
        return keys, ids, most

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of piece hashes, -1 where there is no such piece."""
        known, ids, most = self.table
        at = (keys >> np.uint64(64 - int(len(ids)).bit_length() + 1)).astype(np.int64)
        taken = ids[at]
        out = np.where(known[at] == keys, taken, -1)
        # Only taken slots that hold another piece lead on to the next one.
        open_ = np.nonzero((taken >= 0) & (out < 0))
        at, keys = at[open_], keys[open_]
        for _ in range(most):
            if not len(at):
                break
            at = (at + 1) % len(ids)
            hit = known[at] == keys
            out[tuple(x[hit] for x in open_)] = ids[at[hit]]
            on = ~hit & (ids[at] >= 0)
            at, keys, open_ = at[on], keys[on], tuple(x[on] for x in open_)
        return out


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
    return out


def _spans(prefixes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of one length."""
    power = np.uint64(pow(int(_BASE), length, 1 << 64))
    return mix(prefixes[:, length:] - prefixes[:, :-length] * power + np.uint64(length))


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Vocabulary file with log probabilities by rank.

    The file's scores are ranks (0, -1, -2 ... in the order of its ordinary pieces), which are no probabilities; the usual
    rank law 1 / (rank + 2.7) stands in for them. Pieces of blanks, which the file only keeps out of its merges, take the
    rank of their place. Byte pieces get a tenth of the rarest piece each.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(n))
    kind = np.array([1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)])
    for piece, k in zip(pieces, kind):
        if k == 0 and ("\n" in piece or (BLANK in piece.lstrip(BLANK))):
            raise ValueError(f"the piece {piece!r} reaches across a chunk border")
    if (kind == 1).sum() != 256:
        raise ValueError("the vocabulary has no piece for every byte")
    weight = np.where(kind == 0, 1.0 / (np.cumsum(kind == 0) + 1.7), 0.0)
    weight[kind == 1] = weight[weight > 0].min() / 10
    with np.errstate(divide="ignore"):
        logs = np.log(weight / weight.sum())
    return Vocabulary(pieces, np.maximum(logs, -1e9), kind)


def _codes(chunks: list[str]) -> np.ndarray:
    """Code points of chunks of equal length; the blanks become blank signs, literal signs a code of their own."""
    out = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).reshape(len(chunks), -1).copy()
    out[out == ord(BLANK)] = _LITERAL
    out[out == 32] = ord(BLANK)
    return out


def _spelled_bytes(code: int) -> bytes:
    return (BLANK if code == _LITERAL else chr(code)).encode()


class Lattice:
    """All pieces of chunks of equal length: ``ids[l][row, i]`` is the piece of length l at place i, or -1."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray) -> None:
        self.vocabulary, self.codes = vocabulary, codes
        self.rows, self.size = codes.shape
        prefixes = _prefixes(codes)
        self.ids = {length: vocabulary.find(_spans(prefixes, length)) for length in range(1, min(vocabulary.longest, self.size) + 1)}
        missing = self.ids[1] < 0
        # A character that is no piece is spelled by its bytes, as one step.
        self.spelled = np.zeros(codes.shape)
        if missing.any():
            values, inverse = np.unique(codes[missing], return_inverse=True)
            cost = np.array([vocabulary.logs[vocabulary.byte_ids[list(_spelled_bytes(int(v)))]].sum() for v in values])
            self.spelled[missing] = cost[inverse]
        self.missing = missing

    def step(self, length: int) -> np.ndarray:
        """Log probability of the piece of this length at each place."""
        ids = self.ids[length]
        out = np.where(ids >= 0, self.vocabulary.logs[ids], -np.inf)
        if length == 1:
            out = np.where(self.missing, self.spelled, out)
        return out

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Score of the best segmentation, and the length of its last piece at each place; ties go to the longer piece."""
        steps = {length: self.step(length) for length in self.ids}
        score = np.full((self.rows, self.size + 1), -np.inf)
        last = np.zeros((self.rows, self.size + 1), dtype=np.int64)
        score[:, 0] = 0.0
        for j in range(1, self.size + 1):
            for length in range(min(len(steps), j), 0, -1):
                value = score[:, j - length] + steps[length][:, j - length]
                better = value > score[:, j]
                score[better, j] = value[better]
                last[better, j] = length
        return score[:, -1], last

    def forward(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Log sums over all segmentations of each prefix."""
        steps = {length: self.step(length) for length in self.ids}
        alpha = np.full((self.rows, self.size + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, self.size + 1):
            alpha[:, j] = _log_sum([alpha[:, j - length] + steps[length][:, j - length] for length in range(1, min(len(steps), j) + 1)])
        return alpha, steps

    def expected(self, weights: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, weighted by row."""
        alpha, steps = self.forward()
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0.0
        for i in range(self.size - 1, -1, -1):
            beta[:, i] = _log_sum([beta[:, i + length] + steps[length][:, i] for length in range(1, min(len(steps), self.size - i) + 1)])
        out = np.zeros(len(self.vocabulary.pieces))
        for length, step in steps.items():
            chance = np.exp(alpha[:, : self.size + 1 - length] + step + beta[:, length:] - alpha[:, -1:]) * weights[:, None]
            known = self.ids[length] >= 0
            out += np.bincount(self.ids[length][known], chance[known], minlength=len(out))
            if length == 1 and self.missing.any():
                for code, c in zip(self.codes[self.missing], chance[self.missing]):
                    np.add.at(out, self.vocabulary.byte_ids[list(_spelled_bytes(int(code)))], c)
        return out


def _log_sum(values: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(values)
    top = stacked.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stacked - safe).sum(axis=0))


class StreamingViterbi:
    """Best segmentation of a character stream in bounded memory.

    Scores are kept for the last ``longest`` places, from which any later piece must start. Whenever the back pointers of all
    these places lead through one boundary, the pieces up to it can no longer change: they are committed and forgotten.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.text: list[int] = []
        self.score, self.back = [0.0], [0]

    def feed(self, codes: Iterable[int]) -> Iterator[int]:
        ids, logs, longest = self.vocabulary.ids, self.vocabulary.logs, self.vocabulary.longest
        for count, code in enumerate(codes):
            self.text.append(code)
            j = len(self.text)
            top, origin = -np.inf, j - 1
            tail = "".join(chr(c) if c < _LITERAL else "\0" for c in self.text[max(0, j - longest) :])
            if code == _LITERAL or tail[-1] not in ids:
                top = self.score[j - 1] + float(logs[self.vocabulary.byte_ids[list(_spelled_bytes(code))]].sum())
            for length in range(len(tail), 0, -1):
                found = ids.get(tail[-length:]) if code != _LITERAL and _LITERAL not in self.text[j - length :] else None
                if found is not None:
                    value = self.score[j - length] + logs[found]
                    if value > top or (value == top and length > j - origin):
                        top, origin = value, j - length
            self.score.append(top)
            self.back.append(origin)
            if count % longest == longest - 1:
                yield from self._commit(self._converged())

    def close(self) -> Iterator[int]:
        yield from self._commit(len(self.text))

    def _converged(self) -> int:
        """Last boundary on the paths of all places a later piece can start from."""
        alive = set(range(max(0, len(self.text) - self.vocabulary.longest + 1), len(self.text) + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(self.back[last])
        return alive.pop()

    def _commit(self, upto: int) -> Iterator[int]:
        cuts = [upto]
        while cuts[-1] > 0:
            cuts.append(self.back[cuts[-1]])
        cuts.reverse()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield from piece_ids(self.vocabulary, self.text[a:b])
        del self.text[:upto], self.score[:upto], self.back[:upto]
        self.back = [max(0, x - upto) for x in self.back]


def piece_ids(vocabulary: Vocabulary, codes: list[int]) -> list[int]:
    found = vocabulary.ids.get("".join(map(chr, codes))) if _LITERAL not in codes else None
    return [found] if found is not None else [int(vocabulary.byte_ids[b]) for b in _spelled_bytes(codes[0])]


def best_ids(vocabulary: Vocabulary, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of each chunk, one after the other, and the offsets."""
    found: list[np.ndarray | list[int]] = [np.empty(0, np.int64)] * len(chunks)
    for rows, codes in by_length(chunks):
        if codes is None:
            stream = StreamingViterbi(vocabulary)
            found[rows[0]] = [*stream.feed(_codes([chunks[rows[0]]])[0].tolist()), *stream.close()]
            continue
        lattice = Lattice(vocabulary, codes)
        _, last = lattice.best()
        row, place = np.arange(lattice.rows), np.full(lattice.rows, lattice.size)
        steps = []
        while len(row):
            length = last[row, place]
            place = place - length
            ids = np.empty(len(row), dtype=np.int64)
            for n in np.unique(length):
                at = length == n
                ids[at] = lattice.ids[int(n)][row[at], place[at]]
            # A spelled character is marked by its place and expanded below.
            ids = np.where(ids < 0, -1 - place, ids)
            steps.append((row, ids))
            row, place = row[place > 0], place[place > 0]
        every_row, every_id = np.concatenate([s[0] for s in steps])[::-1], np.concatenate([s[1] for s in steps])[::-1]
        order = np.argsort(every_row, kind="stable")
        every_id, ends = every_id[order], np.searchsorted(every_row[order], np.arange(lattice.rows + 1))
        spelled = np.zeros(lattice.rows, dtype=bool)
        spelled[every_row[order][every_id < 0]] = True
        for i, r in enumerate(rows):
            part = every_id[ends[i] : ends[i + 1]]
            if spelled[i]:
                part = [y for x in part.tolist() for y in ([x] if x >= 0 else vocabulary.byte_ids[list(_spelled_bytes(int(codes[i, -1 - x])))].tolist())]
            found[r] = part
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
    return np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64), offsets


def by_length(chunks: list[str]) -> Iterator[tuple[list[int], np.ndarray | None]]:
    """Places of chunks of one length with their codes, a bounded number at a time; chunks beyond LOCKSTEP one by one."""
    groups: dict[int, list[int]] = {}
    for i, chunk in enumerate(chunks):
        if chunk:
            groups.setdefault(len(chunk), []).append(i)
    for length, places in groups.items():
        if length > LOCKSTEP:
            for place in places:
                yield [place], None
            continue
        rows = _CHARACTERS // length
        for at in range(0, len(places), rows):
            part = places[at : at + rows]
            yield part, _codes([chunks[i] for i in part])


def log_sums(vocabulary: Vocabulary, chunks: list[str]) -> np.ndarray:
    """Log probability of each chunk, summed over all its segmentations."""
    out = np.zeros(len(chunks))
    for rows, codes in by_length(chunks):
        if codes is None:
            out[rows[0]] = _long_log_sum(vocabulary, chunks[rows[0]])
        else:
            out[rows] = Lattice(vocabulary, codes).forward()[0][:, -1]
    return out


def _long_log_sum(vocabulary: Vocabulary, chunk: str) -> float:
    """The forward recursion with the sums of the last places only."""
    window = [0.0]
    text = [c if c != _LITERAL else None for c in _codes([chunk])[0].tolist()]
    ids, logs, longest = vocabulary.ids, vocabulary.logs, vocabulary.longest
    for j in range(1, len(text) + 1):
        terms = []
        if text[j - 1] is None or chr(text[j - 1]) not in ids:
            code = _LITERAL if text[j - 1] is None else text[j - 1]
            terms.append(window[-1] + float(logs[vocabulary.byte_ids[list(_spelled_bytes(code))]].sum()))
        piece = ""
        for length in range(1, min(longest, j) + 1):
            if text[j - length] is None:
                break
            piece = chr(text[j - length]) + piece
            if piece in ids:
                terms.append(window[-length] + float(logs[ids[piece]]))
        window.append(float(np.logaddexp.reduce(terms)))
        window = window[-longest:]
    return window[-1]


def expected_uses(vocabulary: Vocabulary, chunks: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over weighted chunks. A chunk beyond LOCKSTEP counts by its best segmentation."""
    out = np.zeros(len(vocabulary.pieces))
    for rows, codes in by_length(chunks):
        if codes is None:
            stream = StreamingViterbi(vocabulary)
            used = [*stream.feed(_codes([chunks[rows[0]]])[0].tolist()), *stream.close()]
            np.add.at(out, used, weights[rows[0]])
        else:
            out += Lattice(vocabulary, codes).expected(weights[rows])
    return out
