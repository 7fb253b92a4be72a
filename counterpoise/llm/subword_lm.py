"""Document probabilities from a subword lattice: the sum over all segmentations, not the best one.

A unigram model over an existing piece vocabulary gives every segmentation of a word the product of its pieces'
probabilities; a forward recursion in log space sums them up. A text is its words, each with its leading blank, and one
end. The vocabulary's rank scores start the model; expectation steps over all training words, weighted by their counts,
fit the piece probabilities (forward and backward sums). No piece reaches across words, so a text's log probability is the
sum of its words', each computed once per distinct word.

Words are counted in two steps, within each Arrow batch and then by shuffle. Scores meet the documents in two ways with the
same result: the words above a count that at most ``head_words`` words reach are looked up where the text is read (a table
of bounded size), all others go through a join on the word.

Defined results: null and empty texts have the end only; a word with characters outside the vocabulary is spelled by byte
pieces; every piece keeps a small probability, so no score is infinite; without training rows the vocabulary's scores and
add-half counts of nothing are used; rows are documents, so a repeated row is scored and counted again; very long words
are summed up in a window of the longest piece and count in the fit by their best segmentation; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.hashing import lowered, row_slices, text_buffers, word_hashes
from counterpoise.llm.pieces import VOCABULARY, Vocabulary, expected_uses, load_vocabulary, log_sums
from counterpoise.session import stage

_LOG10 = np.log(10.0)


def held_out(key: str | Column) -> Column:
    """Rows the model never learns from: crc32 of the key as text, modulo 5, is 1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _words_at(data: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The lower-cased words at the places, as binary."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    body = lowered(data[np.repeat(places - ends[:-1], lengths) + np.arange(ends[-1])])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``word, n, train``: how often each word occurs in all texts and in the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn, row = ~batch["held"].to_numpy(zero_copy_only=False), 0
            for part in row_slices(batch["t"], 8 << 20):
                data, offsets = text_buffers(part)
                hashes, at, places, lengths = word_hashes(data, offsets)
                train = np.repeat(learn[row : row + len(part)], np.diff(at))
                row += len(part)
                _, once, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                learned = np.bincount(which[train], minlength=len(once))
                words = _words_at(data, places[once], lengths[once]).cast(pa.binary())
                yield pa.record_batch({"word": words, "n": pa.array(n.astype(np.int64)), "train": pa.array(learned.astype(np.int64))})

    rows = docs.select(F.col(text).alias("t"), held_out(key).alias("held"))
    return rows.mapInArrow(counted, "word binary, n long, train long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


def _chunks(words: pa.Array) -> list[str]:
    return [" " + w.decode() for w in words.to_pylist()]


def fit(words: DataFrame, texts: int, vocabulary: Vocabulary, rounds: int = 2, smooth: float = 0.05) -> Vocabulary:
    """Piece probabilities after ``rounds`` expectation steps over the training words and one end per training text.

    Each step returns one row per piece; ``smooth`` uses are added to every piece.
    """
    for _ in range(rounds):
        current = vocabulary

        def used(batches: Iterator[pa.RecordBatch], current: Vocabulary = current) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(current.pieces))
            for batch in batches:
                total += expected_uses(current, _chunks(batch["word"]), batch["train"].to_numpy().astype(float))
            some = np.flatnonzero(total)
            yield pa.record_batch({"piece": pa.array(some), "uses": pa.array(total[some])})

        uses = words.where("train > 0").select("word", "train").mapInArrow(used, "piece long, uses double")
        weight = np.where(current.kind == 2, 0.0, smooth)
        for row in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            weight[row["piece"]] += row["uses"]
        weight[current.end_id] = texts + smooth
        with np.errstate(divide="ignore"):
            vocabulary = _tabled(current.with_logs(np.maximum(np.log(weight / weight.sum()), -1e9)))
    return vocabulary


def _tabled(vocabulary: Vocabulary) -> Vocabulary:
    # Made once on the driver, sent along with the function.
    _ = vocabulary.table, vocabulary.ids, vocabulary.byte_ids, vocabulary.longest
    return vocabulary


def _scored_words(words: DataFrame, vocabulary: Vocabulary, tokens: int, types: int) -> DataFrame:
    """``word, n, known, base, model`` (log10) of every distinct word."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = log_sums(vocabulary, _chunks(batch["word"])) / _LOG10
            yield pa.record_batch({"word": batch["word"], "n": batch["n"], "train": batch["train"], "model": pa.array(sums)})

    rows = words.mapInArrow(scored, "word binary, n long, train long, model double")
    base = F.log10((F.col("train") + 0.5) / F.lit(tokens + 0.5 * (types + 1)))
    return rows.select("word", "n", (F.col("train") > 0).cast("long").alias("known"), base.alias("base"), "model")


def _head(scored: DataFrame, head_words: int) -> tuple[float, dict[str, np.ndarray]]:
    """The words above the smallest count step that at most ``head_words`` words reach, by hash."""
    step = F.floor(F.log2("n") * 8)
    count, least = 0, float("inf")
    for row in sorted(scored.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        count += row["count"]
        if count > head_words:
            break
        least = float(row["s"])
    rows = scored.where(step >= F.lit(least)).where(F.length("word") <= 64).select("word", "known", "base", "model")
    table = rows.toArrow()
    body = table["word"].combine_chunks() if table.num_rows else pa.array([], pa.binary())
    data, offsets = text_buffers(pa.array([w.decode() for w in body.to_pylist()], pa.string()))
    hashes, at, _, _ = word_hashes(data, offsets)
    order = np.argsort(hashes)
    return least, {"key": hashes[order]} | {c: table[c].to_numpy()[order].astype(float) for c in ("known", "base", "model")}


_TEXT_ROW = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("n", "known", "base", "model")]
    + [T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))]
)


def score_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, rounds: int = 2, head_words: int = 200_000,
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text."""
    words = stage(word_counts(docs, key, text), "lm-words")
    texts = docs.where(~held_out(key)).count()
    trained, types = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))).first()
    # The end is a token and a type of its own.
    tokens, types = trained + texts, types + (texts > 0)
    vocabulary = fit(words, texts, _tabled(load_vocabulary(path)), rounds if texts else 0)
    if not texts:
        weight = np.exp(vocabulary.logs)
        weight[vocabulary.end_id] = weight[vocabulary.kind == 0].mean()
        vocabulary = _tabled(vocabulary.with_logs(np.maximum(np.log(weight / weight.sum()), -1e9)))
    end_model = float(vocabulary.logs[vocabulary.end_id]) / _LOG10
    end_base = float(np.log10((texts + 0.5) / (tokens + 0.5 * (types + 1))))
    scored = stage(_scored_words(words, vocabulary, tokens, types), "lm-scored")
    least, head = _head(scored, head_words)
    shared = docs.sparkSession.sparkContext.broadcast(head)

    @F.arrow_udf(_TEXT_ROW)
    def summed(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([_summed(part, shared.value) for part in row_slices(column)] or [_summed(column, shared.value)])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), summed(F.col(text)).alias("s"))
    rows = stage(rows.select("row", "k", "s.*"), "lm-texts")
    tail = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    rest = scored.where((F.floor(F.log2("n") * 8) < F.lit(least)) | (F.length("word") > 64)).drop("n")
    tail = tail.join(rest, "word").groupBy("row").agg(*[F.sum(F.col("c") * F.col(c)).alias(f"t_{c}") for c in ("known", "base", "model")])
    out = rows.join(tail, "row", "left")
    both = {c: F.col(c) + F.coalesce(F.col(f"t_{c}").cast("double"), F.lit(0.0)) for c in ("known", "base", "model")}
    return out.select(
        F.col("k").alias(key), held_out("k").alias("held_out"), (F.col("n") + 1).cast("long").alias("n_tokens"),
        (both["known"] + int(texts > 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (both["base"] + end_base).alias("base_score"), (both["model"] + end_model).alias("score"),
    )


def _summed(column: pa.Array, head: dict[str, np.ndarray]) -> pa.Array:
    """Per text: words, sums over the head's words, and the other words with their counts."""
    data, offsets = text_buffers(column)
    hashes, at, places, lengths = word_hashes(data, offsets)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    place = np.minimum(np.searchsorted(head["key"], hashes), max(0, len(head["key"]) - 1))
    hit = head["key"][place] == hashes if len(head["key"]) else np.zeros(len(hashes), dtype=bool)
    sums = [np.bincount(row[hit], head[c][place[hit]], minlength=len(column)) for c in ("known", "base", "model")]
    row, hashes, places, lengths = row[~hit], hashes[~hit], places[~hit], lengths[~hit]
    # Equal words of one text become one entry.
    order = np.lexsort((hashes, row))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(order)))
    kept = order[starts]
    ends = np.searchsorted(row[kept], np.arange(len(column) + 1)).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(ends), _words_at(data, places[kept], lengths[kept]).cast(pa.binary()))
    counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int64)))
    numbers = [pa.array(x.astype(float)) for x in (np.diff(at), *sums)]
    return pa.StructArray.from_arrays([*numbers, words, counts], names=[f.name for f in _TEXT_ROW.fields])
