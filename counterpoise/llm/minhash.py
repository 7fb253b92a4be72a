"""Near-duplicate documents by fast similarity sketching.

A sketch has ``bins`` places. In round i < bins every shingle is hashed to one place and to a value that grows with the
round; a place keeps its smallest value, and a document stops as soon as all its places are filled. Rounds from ``bins`` on
throw all shingles at one place each, so that every place fills whatever the number of shingles. Two documents agree at a
place with the probability of their Jaccard similarity, with concentration as for independent hashes.

Bands of places make buckets. Within a bucket the sketches themselves are compared, and pairs whose estimate is at least
five deviations below the threshold go on as candidate links; the classes they form are then joined exactly, on the full
shingle sets. Copies (equal sets) are represented by their smallest key throughout. Buckets and classes of any size are cut
into tiles whose pairs meet in bounded pieces, and a piece emits a spanning forest, never all its pairs.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; fewer words than a
shingle make one shingle of all of them; rows are documents, so equal rows are copies of each other; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.hashing import mix, row_slices, shingle_hashes, text_buffers, word_hashes
from counterpoise.llm.linking import by_piece, components, in_tiles, spanning_links, whole_runs
from counterpoise.session import stage

# Working memory of the sketches: shingles and rows taken at a time.
_PIECE_SHINGLES, _PIECE_ROWS = 1 << 19, 2_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(shingles: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Sketches, one row per document; places of documents without shingles stay empty."""
    rows = len(offsets) - 1
    out = np.full((rows, bins), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    for i in range(2 * bins):
        if not len(row):
            break
        seed = np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)
        value = mix(shingles + seed)
        place = ((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if i < bins else np.full(len(row), i - bins, dtype=np.uint64)
        # The round comes first, so a place filled in an earlier round keeps its value.
        value = np.uint64(i << 48) | (mix(value) >> np.uint64(16))
        np.minimum.at(flat, row * bins + place.astype(np.int64), value)
        open_rows = (out == _EMPTY).any(axis=1)
        if not open_rows[row].all():
            still = open_rows[row]
            row, shingles = row[still], shingles[still]
    return out


def _described(column: pa.Array, bins: int, width: int) -> Iterator[tuple]:
    data, offsets = text_buffers(column)
    words, at, _, _ = word_hashes(data, offsets)
    shingles, ends = shingle_hashes(words, at, width)
    low = 0
    while low < len(column):
        high = min(low + _PIECE_ROWS, max(low + 1, int(np.searchsorted(ends, ends[low] + _PIECE_SHINGLES, "right")) - 1), len(column))
        part = sketch(shingles[ends[low] : ends[high]], ends[low : high + 1] - ends[low], bins)
        code = mix(part)
        near, far = (code & np.uint64(255)).astype(np.uint8), ((code >> np.uint64(8)) & np.uint64(255)).astype(np.uint8)
        for r in range(high - low):
            own = shingles[ends[low + r] : ends[low + r + 1]]
            if len(own):
                yield hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), near[r].tobytes(), far[r].tobytes()
            else:
                yield None, 0, None, None
        low = high


_DESCRIBED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("near", T.BinaryType()), T.StructField("far", T.BinaryType())])


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5, rows_per_band: int = 5, bands: int = 40,
    tile_rows: int = 1024, tile_shingles: int = 1 << 20,
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every document: classes of Jaccard similarity >= ``percent`` / 100.

    With 5 places a band and 40 bands a pair right at 0.75 is missed with a probability of 2e-5.
    """
    bins = rows_per_band * bands
    estimate = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / bins) ** 0.5
    least = max(1, int(estimate * bins))

    @F.arrow_udf(_DESCRIBED)
    def described(column: pa.Array) -> pa.Array:
        rows = [row for part in row_slices(column) for row in _described(part, bins, width)]
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "n", "near", "far"])

    table = stage(docs.select(F.col(key).alias("k"), described(F.col(text)).alias("d")).select("k", "d.*"), "sketches")
    copies = stage(table.where("n > 0").groupBy("digest").agg(F.min("k").alias("rep")), "sketch-copies")
    first = table.join(copies.select("digest", F.col("rep").alias("k")), ["digest", "k"], "left_semi").dropDuplicates(["digest", "k"])
    first = stage(first, "sketch-reps")

    candidates = components(_candidate_links(first, rows_per_band, bands, least, tile_rows), "sketch-classes")
    candidates = stage(candidates.join(first.select(F.col("k").alias("node"), "n"), "node"), "sketch-members")
    links = stage(_exact_links(docs, key, text, candidates, percent, width, tile_shingles), "sketch-links")
    classes = components(links, "sketch-components")

    named = table.join(copies, "digest", "left").join(classes, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "k")
    return named.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("k") == component).alias("kept"))


def _candidate_links(first: DataFrame, rows_per_band: int, bands: int, least: int, tile_rows: int) -> DataFrame:
    part = lambda c, i: F.substring(F.col(c), i * rows_per_band + 1, rows_per_band)
    keys = F.array(*[F.xxhash64(F.lit(i), part("near", i), part("far", i)) for i in range(bands)])
    members = first.select("k", F.explode(keys).alias("band"))
    pieces = in_tiles(members, ["band"], F.col("k"), F.lit(1), tile_rows)
    pieces = by_piece(pieces.join(first.select("k", "near"), "k"), ["band"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["band", "lo", "hi"]):
            ids = table["k"].to_numpy()
            codes = np.frombuffer(b"".join(table["near"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            sizes = np.diff(at)
            # Buckets of two, by far the most, are compared at once.
            two = at[:-1][sizes == 2]
            hit = (codes[two] == codes[two + 1]).sum(axis=1) >= least
            a, b = [ids[two[hit]]], [ids[two[hit] + 1]]
            for start, end in zip(at[:-1][sizes > 2], at[1:][sizes > 2]):
                own = codes[start:end]
                found = spanning_links(end - start, lambda i, rest: (own[rest] == own[i]).sum(axis=1) >= least)
                if found:
                    left, right = np.array(found).T
                    a.append(ids[start + left])
                    b.append(ids[start + right])
            yield pa.record_batch({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return pieces.select("band", "lo", "hi", F.col("k").cast("long").alias("k"), "near").mapInArrow(linked, "a long, b long")


def _exact_links(docs: DataFrame, key: str, text: str, candidates: DataFrame, percent: int, width: int, tile_shingles: int) -> DataFrame:
    @F.arrow_udf(T.BinaryType())
    def sets(column: pa.Array) -> pa.Array:
        out = []
        for part in row_slices(column):
            words, at, _, _ = word_hashes(*text_buffers(part))
            shingles, ends = shingle_hashes(words, at, width)
            out += [shingles[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        return pa.array(out, pa.binary())

    whole = docs.select(F.col(key).alias("node"), F.col(text).alias("t")).join(candidates.select("node", F.col("component").alias("class"), "n"), "node")
    rows = in_tiles(candidates.select("node", F.col("component").alias("class"), "n"), ["class"], F.col("node"), F.col("n"), tile_shingles)
    rows = rows.select("node", "lo", "hi").join(whole.select("node", "class", sets("t").alias("s")), "node")
    pieces = by_piece(rows, ["class"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["class", "lo", "hi"]):
            ids, bodies = table["node"].to_numpy(), table["s"].combine_chunks()
            a, b = [], []
            for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
                own = [np.frombuffer(bodies[r].as_buffer(), dtype=np.uint64) for r in range(start, end)]
                for i, j in _linked_sets(own, percent):
                    a.append(int(ids[start + i]))
                    b.append(int(ids[start + j]))
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pieces.select("class", "lo", "hi", F.col("node").cast("long").alias("node"), "s").mapInArrow(linked, "a long, b long").where("a <> b")


def _linked_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links among sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(names), dtype=bool)
    held = {"rest": np.arange(len(sets)), "ids": ids, "starts": ends[:-1], "rows": np.arange(len(sets))}

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        if len(rest) < 0.7 * len(held["rows"]):
            # Rows already reached leave the compared ones.
            held["rows"] = rest
            held["ids"] = np.concatenate([ids[ends[r] : ends[r + 1]] for r in rest])
            held["starts"] = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
        mine = ids[ends[i] : ends[i + 1]]
        mark[mine] = True
        counts = np.add.reduceat(mark[held["ids"]], held["starts"], dtype=np.int64)
        mark[mine] = False
        shared = counts[np.searchsorted(held["rows"], rest)]
        return 100 * shared >= percent * (sizes[i] + sizes[rest] - shared)

    return spanning_links(len(sets), near)
