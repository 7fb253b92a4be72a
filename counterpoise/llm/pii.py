"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find the base spans. The field adds what they miss: a number glued to another one, separators or spellings
that a pattern does not know. It scores whole candidate segments (structure, checksum, grouping, borders, cue words), and
dynamic programming over segments of bounded length chooses borders and types together. Stretches of text that no
candidate can touch have only one labelling, so each zone around a digit, an ``@`` or a spelled-out sign is decoded by
itself; base spans are held fixed, and candidates that overlap one are not considered.

The weights are fitted by the conditional likelihood (forward and backward sums over the same segments) to zones whose
labels the patterns give, to rewritten copies of them that the patterns miss, and to numbers that fail their checks. The
zones come from the ``sample_rows`` documents of the smallest key hashes, their first 20,000 characters and zones of up to
1,000, spread over all of them and all kinds, until there are about 240 examples; without any the prior weights stand.

Defined results: null and empty texts have no spans; texts of any length are read whole; a table without personal data or
without rows works with the prior weights; repeated rows get equal spans; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.functions.hashing import keyed_uniform

# The kinds in their order and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: the run's first digit would match as well, and earlier.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Longest entity, in atoms and in characters, and how far a cue word may stand before it.
MAX_ATOMS, MAX_CHARS, CUE_CHARS = 40, 96, 28
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
_TRIGGER = re.compile(r"[0-9@]")
_SPELLED = re.compile(r"[\[({<]\s?(?:at|dot)\s?[\])}>]| at [A-Za-z0-9-]+(?:\.| dot )[A-Za-z]", re.IGNORECASE)
_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s@\s?|@\s| at ", re.IGNORECASE)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?| dot ", re.IGNORECASE)
_CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|addr|ping", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|credit|debit|pay|pan\b", re.IGNORECASE),
    "phone": re.compile(r"phone|tel\b|tel\.|call|fax|mobile|cell|whatsapp|sms", re.IGNORECASE),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern matches that pass their checks, in order."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        # The only match around this sign starts where the run of name characters before it starts.
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    if _TRIGGER.search(text):
        for m in _IP.finditer(text):
            if _octets(m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that some candidate can touch, wide enough for the longest entity; none crosses a line end."""
    spots = (m.start() for m in _TRIGGER.finditer(text))
    if " at " in text or any(b in text for b in "[({<"):
        spots = merge(spots, (m.start() for m in _SPELLED.finditer(text)))
    low = high = -1
    for spot in spots:
        if spot < high - MAX_CHARS:
            continue
        a = max(text.rfind("\n", max(0, spot - MAX_CHARS), spot) + 1, spot - MAX_CHARS, 0)
        b = text.find("\n", spot, spot + MAX_CHARS)
        b = min(spot + MAX_CHARS, len(text)) if b < 0 else b
        if low >= 0 and a <= high:
            high = max(high, b)
        else:
            if low >= 0:
                yield low, high
            low, high = a, b
    if low >= 0:
        yield low, high


FEATURES = ("bias", "valid", "failing", "left_clean", "right_clean", "cue", "one_separator", "grouping", "prefix", "other_cue", "alone", "plain")
# Prior means of the weights, per kind in the order of FEATURES; the fit is drawn towards them.
PRIOR = np.array([
    [-7.0, 8.5, -6.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, -0.5, 0.0, 1.0],
    [-7.0, 8.0, -9.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.0, -0.5, 0.5, 0.0],
    [-7.0, 6.0, -9.0, 1.0, 1.0, 1.0, 0.5, 1.0, 0.0, -1.0, 0.5, 0.0],
    [-9.0, 3.0, -6.0, 1.0, 1.0, 3.0, 0.5, 1.5, 2.5, -2.0, 0.5, 0.0],
])
# Per pair of neighbouring labels: two entities touching without any text between them are unlikely.
TOUCHING = -4.0


_RUN = re.compile(r"[+(]?[0-9][0-9 ().\-\[\]]*")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*")


def _borders(zone: str) -> array:
    """Starts of the atoms, which leave no gap, and the end."""
    return array("q", [*(m.start() for m in _ATOM.finditer(zone)), len(zone)])


def _candidates(zone: str, held: list[tuple[int, int]]) -> tuple[array, list[tuple[int, int, int, np.ndarray]]]:
    """Borders and all segments of a short zone, for fitting."""
    borders = _borders(zone)
    return borders, list(_segments(zone, borders, held))


def _segments(zone: str, borders: array, held: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(first atom, end atom, kind, features)`` of every segment that could be an entity, by first atom.

    Segments that overlap a held span are left out.
    """
    atoms = len(borders) - 1
    signs = [(m.start(), m.end()) for m in _AT.finditer(zone)] + [(m.start(), m.end()) for m in re.finditer("@", zone)]
    taken = np.zeros(len(zone) + 1, dtype=bool)
    for a, b in held:
        taken[a:b] = True
    walls = np.append(np.flatnonzero(taken), len(zone))
    for i in range(atoms):
        start = borders[i]
        head = zone[start]
        digit, letter = "0" <= head <= "9", head.isascii() and head.isalpha()
        if not (digit or letter or head in "+(") or taken[start]:
            continue
        wall = min(int(walls[np.searchsorted(walls, start)]), start + MAX_CHARS)
        run = _RUN.match(zone, start, wall) if not letter else None
        last = run.end() if run else start
        # A spelled address: the name reaches up to a sign.
        name = _NAME.match(zone, start, wall) if head not in "+(" and signs else None
        sign = next((e for a, e in signs if start < a <= name.end()), None) if name else None
        digits = groups = 0
        for j in range(i + 1, min(atoms, i + MAX_ATOMS) + 1):
            a, end = borders[j - 1], borders[j]
            if end > wall or (end > last and sign is None):
                break
            tail = zone[end - 1]
            if not (tail.isalnum() and tail.isascii()):
                continue
            if tail.isdigit():
                digits += end - a
                groups += 1
            kinds = []
            # Numbers are written in groups of two digits or more on average, addresses in four.
            if end <= last and 4 <= digits <= 19 and (groups == 4 or 2 * groups <= digits):
                kinds += _numeric(zone[start:end])
            if sign is not None and end > sign:
                kinds += _spelled(zone[start:end])
            for kind, shape in kinds:
                yield i, j, kind, _vector(zone, start, end, kind, shape)


def _numeric(body: str) -> list[tuple[int, dict[str, float]]]:
    digits = _digits(body)
    n = len(digits)
    separators = re.findall(r"[^0-9+]+", body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    one = float(len(set(separators)) <= 1)
    out = []
    plain = _DOT.sub(".", body)
    parts = plain.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        good = _octets(parts)
        out.append((1, {"valid": good, "failing": not good, "one_separator": one, "grouping": all(len(p) <= 3 for p in parts)}))
    if 12 <= n <= 19 and body[0].isdigit() and all(s in (" ", "-", ".", "  ") for s in separators):
        good = luhn(digits)
        out.append((2, {"valid": good, "failing": not good, "one_separator": one, "grouping": groups in ([n], [4, 4, 4, 4], [4, 6, 5], [4, 6, 4])}))
    if 7 <= n <= 15 and all(len(s) <= 2 for s in separators):
        marked = body[0] in "+(" or digits.startswith("00")
        usual = len(groups) > 1 and groups[-1] in (2, 3, 4) and max(groups) <= 5
        out.append((3, {"valid": 9 <= n, "failing": n < 9, "one_separator": one, "grouping": usual, "prefix": marked}))
    return out


def _spelled(body: str) -> list[tuple[int, dict[str, float]]]:
    if not _AT.search(body):
        return []
    plain = _DOT.sub(".", _AT.sub("@", body, count=1))
    if " " in plain or plain.count("@") != 1:
        return []
    good = bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain))
    return [(0, {"valid": good, "failing": not good, "plain": plain[0].isalnum()})]


def _vector(zone: str, start: int, end: int, kind: int, shape: dict[str, float]) -> np.ndarray:
    before, after = zone[max(0, start - 3) : start], zone[end : end + 3]
    context = zone[max(0, start - CUE_CHARS) : start]
    cues = [bool(_CUES[k].search(context)) for k in KINDS]
    values = {
        "bias": 1.0, "left_clean": not re.search(r"[A-Za-z0-9_.+@-]$", before), "right_clean": not re.match(r"[A-Za-z0-9_@]|[.-][A-Za-z0-9]", after),
        "cue": cues[kind], "other_cue": any(c for k, c in enumerate(cues) if k != kind) and not cues[kind],
        "alone": not re.search(r"[0-9][ -]?$", before) and not re.match(r"[ -]?[0-9]", after),
    } | shape
    return np.array([float(values.get(f, 0.0)) for f in FEATURES])


def decode(atoms: int, segments: Iterable[tuple[int, int, int, np.ndarray]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Best labelling: ``(first atom, end atom, kind)`` of its entities. State: whether an entity ended right here.

    ``segments`` come by their first atom. A segment is scored and dropped, scores are kept for the last ``MAX_ATOMS`` atoms
    and three bytes an atom lead back, so a zone may be as long as the text.
    """
    coming = iter(segments)
    ahead = next(coming, None)
    by_end: dict[int, list] = {}
    best = [[0.0, -math.inf]] * (MAX_ATOMS + 1)
    outside, length, came = bytearray(atoms + 1), bytearray(atoms + 1), bytearray(atoms + 1)
    for j in range(1, atoms + 1):
        while ahead is not None and ahead[0] < j:
            by_end.setdefault(ahead[1], []).append((ahead[0], ahead[2], float(weights[ahead[2]] @ ahead[3])))
            ahead = next(coming, None)
        before = best[(j - 1) % len(best)]
        outside[j] = before[1] > before[0]
        row = [max(before), -math.inf]
        for i, kind, score in by_end.pop(j, ()):
            for state in (0, 1):
                value = best[i % len(best)][state] + score + TOUCHING * state
                if value > row[1]:
                    row[1], length[j], came[j] = value, j - i, 2 * kind + state
        best[j % len(best)] = row
    last = best[atoms % len(best)]
    j, state, out = atoms, int(last[1] > last[0]), []
    while j > 0:
        if state:
            out.append((j - length[j], j, came[j] // 2))
            j, state = j - length[j], came[j] % 2
        else:
            j, state = j - 1, outside[j]
    return out[::-1]


def expected(atoms: int, segments: list[tuple[int, int, int, np.ndarray]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition sum and each segment's probability, by forward and backward sums over the segments."""
    scores = [float(weights[k] @ v) for _, _, k, v in segments]
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for n, (i, j, _, _) in enumerate(segments):
        ends.setdefault(j, []).append(n)
        starts.setdefault(i, []).append(n)
    forward = np.full((atoms + 1, 2), -np.inf)
    forward[0, 0] = 0.0
    for j in range(1, atoms + 1):
        forward[j, 0] = np.logaddexp(*forward[j - 1])
        for n in ends.get(j, ()):
            i = segments[n][0]
            forward[j, 1] = np.logaddexp(forward[j, 1], np.logaddexp(forward[i, 0], forward[i, 1] + TOUCHING) + scores[n])
    backward = np.full((atoms + 1, 2), -np.inf)
    backward[atoms] = 0.0
    for i in range(atoms - 1, -1, -1):
        backward[i] = backward[i + 1, 0]
        for n in starts.get(i, ()):
            value = scores[n] + backward[segments[n][1], 1]
            backward[i] = np.logaddexp(backward[i], [value, value + TOUCHING])
    whole = float(np.logaddexp(*forward[atoms]))
    chance = np.array([
        math.exp(min(0.0, np.logaddexp(forward[i, 0], forward[i, 1] + TOUCHING) + scores[n] + backward[j, 1] - whole))
        for n, (i, j, _, _) in enumerate(segments)
    ])
    return whole, chance


def _respelled(address: str, sign: str, dot: str) -> str:
    name, _, host = address.partition("@")
    return name + sign + host.replace(".", dot)


def _examples(zone: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """The zone with its labels, and rewritten copies of its spans whose labels are known by construction."""
    yield zone, spans
    for start, kind, end in spans[:2]:
        body, left = zone[start:end], zone[max(0, start - 20) : start]
        rewritten = {
            0: [_respelled(body, " at ", " dot "), _respelled(body, "[at]", "."), _respelled(body, " (at) ", " (dot) ")],
            1: [body.replace(".", "[.]")],
            2: [_digits(body)[:4] + "." + ".".join(_digits(body)[i : i + 4] for i in range(4, len(_digits(body)), 4))],
            3: ["00" + body[1:], body[body.find("(") :] if "(" in body else body[1:]],
        }[kind]
        for new in rewritten:
            yield f"{left}{new}.", [(len(left), kind, len(left) + len(new))]
        if kind == 2:
            glued = "7291 " + body
            yield f"{left}{glued} ", [(len(left) + 5, kind, len(left) + len(glued))]
            # One digit more on the last place spoils the checksum: no entity.
            yield f"{left}{body[:-1]}{(int(body[-1]) + 1) % 10} ", []
        if kind == 1:
            yield f"{left}{body}.{body.split('.')[0]}.9 ", []
            yield f"{left}{body.split('.')[0]}.{300 + len(body)}.1.1 ", []
        if kind == 3:
            yield f"{left}{_digits(body)[:8]} ", []
            yield f"{left}2019-0{1 + len(body) % 9}-1{len(left) % 10} 10:15 ", []


def fit(texts: list[str], zones: int = 240, zone_chars: int = 1_000, steps: int = 20, rate: float = 0.5, pull: float = 0.02) -> np.ndarray:
    """Weights per kind and feature, by gradient ascent on the conditional likelihood drawn towards the prior.

    About ``zones`` examples, taken in turn from all kinds and all texts, of zones up to ``zone_chars`` characters.
    """
    # One queue for each kind of a zone's first span and one for zones without any; every text's first zone before any second.
    queues: list[list] = [[] for _ in range(len(KINDS) + 1)]
    for t, text in enumerate(texts):
        spans = base_spans(text)
        for turn, (low, high) in enumerate(_zones(text)):
            if high - low <= zone_chars:
                inside = [(a - low, k, b - low) for a, k, b in spans if low <= a and b <= high]
                queues[inside[0][1] if inside else -1].append((turn, t, text[low:high], inside))
    examples: list = []
    for group in zip_longest(*[sorted(q) for q in queues]):
        for zone in filter(None, group):
            examples += _examples(*zone[2:])
        if len(examples) >= zones:
            break
    prepared = []
    for zone, spans in examples:
        borders, segments = _candidates(zone, [])
        atoms = len(borders) - 1
        at = {(borders[i], k, borders[j]): n for n, (i, j, k, _) in enumerate(segments)}
        gold, last = [], -1
        for a, k, b in spans:
            if a >= last and (a, k, b) in at:
                gold.append(at[a, k, b])
                last = b
        if segments:
            prepared.append((atoms, segments, gold))
    weights = PRIOR.copy()
    for _ in range(steps if prepared else 0):
        slope = np.zeros_like(weights)
        for atoms, segments, gold in prepared:
            _, chance = expected(atoms, segments, weights)
            chance = -chance
            chance[gold] += 1.0
            for (_, _, kind, vector), c in zip(segments, chance):
                slope[kind] += c * vector
        weights += rate * (slope / len(prepared) - pull * (weights - PRIOR))
    return weights


def find_spans(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as ``(start, kind, end)`` in order."""
    if not text:
        return [], []
    base = base_spans(text)
    every = list(base)
    for low, high in _zones(text):
        held = [(max(a, low) - low, min(b, high) - low) for a, _, b in base if a < high and b > low]
        zone = text[low:high]
        borders = _borders(zone)
        segments = _segments(zone, borders, held)
        first = next(segments, None)
        if first is not None:
            best = decode(len(borders) - 1, chain([first], segments), weights)
            every += [(low + borders[i], kind, low + borders[j]) for i, j, kind in best]
    return base, sorted(every)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
)


def sample_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 400, max_chars: int = 20_000) -> list[str]:
    """The ``sample_rows`` texts of the smallest key hashes among those with a pattern's sign in them; for fitting only.

    So the sample does not depend on the files. Of a text it holds the first ``max_chars`` characters. Before the order a rate
    thins out the rows; it counts on such a sign in one text of 25 or more, where they are rarer the sample is smaller.
    """
    count = docs.count()
    chance = keyed_uniform(F.coalesce(F.col(key).cast("string"), F.lit("")), "pii")
    drawn = docs.select(chance.alias("chance"), F.substring(F.col(text), 1, max_chars).alias("body"), F.col(text).rlike("@|[0-9]{3}").alias("sign"))
    drawn = drawn.where((F.col("chance") < F.lit(25.0 * sample_rows / max(count, 1))) & F.col("sign"))
    return [r[0] for r in drawn.orderBy("chance", "body").limit(sample_rows).select("body").collect()]


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 400) -> DataFrame:
    """Key, counts of base spans per kind, their digest, and all spans of every whole text."""
    weights = fit(sample_texts(docs, key, text, sample_rows))

    @F.arrow_udf(_RESULT)
    def found(column: pa.Array) -> pa.Array:
        rows = []
        for body in column.to_pylist():
            base, every = find_spans(body, weights)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((*counts, digest, written(every), len(every) - len(base)))
        names = [f.name for f in _RESULT.fields]
        arrays = [pa.array([r[i] for r in rows], pa.string() if n in ("base_sha256", "spans") else pa.int64()) for i, n in enumerate(names)]
        return pa.StructArray.from_arrays(arrays, names=names)

    return docs.select(F.col(key).alias("k"), found(F.col(text)).alias("r")).select(F.col("k").alias(key), "r.*")
