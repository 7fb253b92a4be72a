"""Hard negatives by slot-decomposed selection.

Every anchor has positives, its best rows of its own label, and every positive asks for the best rows of other labels whose
scores lie between a share of the positive's score and that score. The windows of one anchor overlap, so they are not searched
one by one: the positives' scores, from the highest down, are the upper limits of disjoint slots, and a row of another label
falls into one slot. A block of rows gives each anchor its ``k`` best rows per slot, a combiner keeps the ``k`` best per slot
over all blocks, and the slots are then merged from the lowest upwards: the best rows of slot i and all below are those of slot
i, which score higher, followed by the best of the slots below. That list answers the window of every positive with that limit.

Anchors and rows meet block by block: each task holds one block of rows and one of anchors, whatever their labels. Scores are
exact: integer products in double precision while they stay below 2**53, in 64-bit integers beyond it.

Defined results: rows with a null id, label or vector, an empty vector or a null or non-finite component take no part; rows
alike in id, label and vector count once; rows that share an id but differ otherwise are rows of their own, though never a
partner of one another; shorter vectors count as padded with zeros; ties go to the smaller id; a positive with a negative score
has an empty window; an anchor without positives or without rows in the window has no result; components or scores that do
not fit a long fail; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterpoise.session import stage

# Scores held at a time by a task.
_SCORES = 1 << 21


def quantised(vector: str | Column, scale: float) -> Column:
    """floor(scale * x) of each component as long, or null for a vector that takes no part."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(scale))
    real = F.forall(F.transform(vector, lambda x: x.cast("double")), lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    fits = F.forall(scaled, lambda x: F.abs(x) < 2.0**62)
    whole = F.transform(scaled, lambda x: F.floor(x).cast("long"))
    return F.when((F.size(vector) > 0) & real, F.when(fits, whole).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("array<bigint>")))


def _matrix(column: pa.ChunkedArray, dims: int, kind: type) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), dtype=kind)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
    return out


def _best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Of the places the k with the highest scores, ties to the smaller id; the ids are in order."""
    if len(places) > k:
        own = scores[places]
        least = np.partition(own, len(own) - k)[len(own) - k]
        places = places[own >= least]
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _slots(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Slot of each score under limits from the highest down: slot i ends at limit i; above the first limit it is -1."""
    return len(limits) - 1 - np.searchsorted(limits[::-1], scores, "left")


class _Meeting:
    """Every block of rows with every block of anchors."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, block_rows: int, anchor_rows: int) -> None:
        count, self.dims, largest = rows.agg(
            F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1)), F.coalesce(F.max(F.aggregate("q", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))), F.lit(0)),
        ).first()
        bound = self.dims * largest * largest
        if bound >= 1 << 63:
            raise ValueError("a score may not fit a long")
        # Sums of products below 2**53 are exact in doubles.
        self.kind = np.float64 if bound < 1 << 53 else np.int64
        blocks, chunks = max(1, -(-count // block_rows)), max(1, -(-anchors.count() // anchor_rows))
        self.rows = rows.withColumn("block", F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int"))
        self.rows = self.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("block", "chunk")
        self.blocks, self.chunks = blocks, chunks

    def best(self, anchors: DataFrame, k: int, slots: bool) -> DataFrame:
        """``r, slot, id, score``: of each block and anchor the k best rows of its label, or the k best per slot of other labels."""
        dims, kind = self.dims, self.kind

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"r": [], "slot": [], "id": [], "score": []}
            if left.num_rows and right.num_rows:
                left = left.sort_by([("id", "ascending"), ("r", "ascending")])
                ids, labels, values = left["id"].to_numpy(), left["label"].to_numpy(), _matrix(left["q"], dims, kind).T.copy()
                asked = _matrix(right["q"], dims, kind)
                step = max(1, _SCORES // len(ids))
                r, own_ids, own_labels = (right[c].to_numpy() for c in ("r", "id", "label"))
                for at in range(0, len(asked), step):
                    scores = (asked[at : at + step] @ values).astype(np.int64)
                    for i, own in enumerate(scores, at):
                        same, other = labels == own_labels[i], ids != own_ids[i]
                        if slots:
                            limits = right["limits"][i].values.to_numpy()
                            slot = _slots(own, limits)
                            picked = [(s, _best(own, ids, np.flatnonzero((slot == s) & ~same & other), k)) for s in range(len(limits))]
                        else:
                            picked = [(0, _best(own, ids, np.flatnonzero(same & other), k))]
                        for s, places in picked:
                            out["r"].append(np.full(len(places), r[i]))
                            out["slot"].append(np.full(len(places), s))
                            out["id"].append(ids[places])
                            out["score"].append(own[places])
            columns = [pa.array(np.concatenate([np.empty(0, np.int64), *v]), pa.int64()) for v in out.values()]
            return pa.table(columns, names=list(out)).set_column(1, "slot", columns[1].cast(pa.int32()))

        asked = anchors.withColumn("chunk", F.pmod(F.xxhash64("r"), F.lit(self.chunks)).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))).groupBy("block", "chunk")
        found = self.rows.cogroup(asked).applyInArrow(answer, "r long, slot int, id long, score long")
        order = Window.partitionBy("r", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, k: int = 5, positives: int = 5, floor_percent: int = 80, key: str = "vec_id", vector: str = "embedding",
    label: str | Column = "label", scale: float = 256.0, block_rows: int = 8192, anchor_rows: int = 4096,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on the rows. For each anchor and each of its best ``positives`` rows of its label: the ``k`` best
    rows of other labels with ``floor_percent`` * positive score <= 100 * score <= 100 * positive score.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), quantised(vector, scale).alias("q"), anchors.alias("anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL").dropDuplicates(["id", "label", "q"])
    rows = stage(rows.withColumn("r", F.monotonically_increasing_id()), "negatives-rows")
    asked = stage(rows.where("anchor").drop("anchor"), "negatives-anchors")
    rows = rows.drop("anchor")
    meeting = _Meeting(rows, asked, block_rows, anchor_rows)
    best = stage(meeting.best(asked, positives, slots=False).select("r", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "n"), "negatives-positives")
    limits = best.groupBy("r").agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("limits"))
    # At most k rows per slot are left of every anchor, so that its list is short.
    held = meeting.best(asked.join(limits, "r"), k, slots=True)
    held = held.groupBy("r").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "slot"))).alias("held"))
    joined = best.join(limits, "r").join(held, "r").join(asked.select("r", F.col("id").alias("anchor_id")), "r")
    joined = joined.withColumn("own_slot", F.array_position("limits", F.col("positive_score")) - 1)
    # Slot by slot in order of score, what stands in the own slot or below begins with the best of the window.
    below = F.slice(F.filter("held", lambda x: x["slot"] >= F.col("own_slot")), 1, k)
    # As decimals: a score times 100 need not fit a long.
    exact = lambda score: score.cast("decimal(20,0)")
    joined = joined.withColumn("window", F.filter(below, lambda x: F.lit(floor_percent) * exact(F.col("positive_score")) <= -100 * exact(x["less"])))
    out = joined.select("anchor_id", "positive_id", "positive_score", F.posexplode("window").alias("at", "x"))
    return out.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.less")).alias("negative_score"),
    )
