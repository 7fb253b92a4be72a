"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.features import UNKNOWN
from counterpoise.functions.hashing import salt
from counterpoise.session import stage


# Places that left rows without a key are spread over.
_NULL_SALTS = 65_536
# Rows of one key that a single task takes.
ROWS_PER_TASK = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task is to take, and the number of tasks their rows need, as ``_salts``."""
    counts = df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    return counts.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str, how: str = "left", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join in which the rows of a hot left key are spread over as many tasks as they need.

    Only hot keys are salted and only their right rows are replicated, so the
    result equals the plain join. Left rows with a null key match nothing and
    are spread like rows of many keys. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    keys = list(keys)
    # At most rows / rows_per_task keys; the written size decides whether they are broadcast.
    hot = stage(hot_keys(left, keys, rows_per_task), "hot-keys")
    no_key = functools.reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    one = F.lit(0)
    spread = left.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(no_key, salt(row_id, _NULL_SALTS)).when(F.col("_salts").isNotNull(), salt(row_id, F.col("_salts"))).otherwise(one),
    ).drop("_salts")
    copies = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_salts").isNotNull(), F.sequence(one, F.col("_salts") - 1)).otherwise(F.array(one))))
        .drop("_salts")
    )
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def lookup_category(
    facts: DataFrame, dictionary: DataFrame, key: str, row_id: str, category: str = "category",
    default: str = UNKNOWN, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Dictionary lookup with a default for keys it does not hold.

    The dictionary may have tens of millions of keys: no broadcast is forced,
    the planner broadcasts it only under its size threshold.
    """
    joined = salted_join(facts, dictionary.select(key, category), [key], row_id, "left", rows_per_task)
    return joined.withColumn(category, F.coalesce(F.col(category), F.lit(default)))


def attach_group_stats(facts: DataFrame, stats: DataFrame, keys: Sequence[str], name: str, how: str = "inner") -> DataFrame:
    """Join per-group statistics back to the rows.

    The statistics are written once; their true file size decides between a
    broadcast (the usual case: the facts are not shuffled at all) and a
    shuffle join that AQE splits at skewed groups.
    """
    return facts.join(stage(stats, name), list(keys), how)


def attach_by_key(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Add computed columns by key; rows keep their place whatever the partition order."""
    return df.join(values, key, "left")


def merge_weight_tables(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer merge of per-unit weight tables in one aggregation instead of a join chain.

    Every table holds ``key`` and its own weight columns. A key that comes
    twice in one table fails when the result is computed: no weight is chosen
    silently.
    """
    union = tables[0].withColumn("_table", F.lit(0))
    for i, table in enumerate(tables[1:], 1):
        union = union.unionByName(table.withColumn("_table", F.lit(i)), allowMissingColumns=True)
    names = [c for c in union.columns if c not in (key, "_table")]
    merged = union.groupBy(key).agg(*[F.max(c).alias(c) for c in names], F.count(F.lit(1)).alias("_rows"), F.count_distinct("_table").alias("_tables"))
    message = F.concat(F.lit(f"{key} comes twice in one weight table: "), F.col(key).cast("string"))
    once = F.when(F.col("_rows") > F.col("_tables"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return merged.where(once).select(key, *names)


def with_weights(units: DataFrame, weights: DataFrame, key: str, defaults: dict[str, str | float]) -> DataFrame:
    """Left join of weights with a default per column: a number, or another column's value."""
    joined = units.join(weights, key, "left")
    filled = {
        name: F.coalesce(F.col(name), F.col(d) if isinstance(d, str) else F.lit(d)) for name, d in defaults.items()
    }
    return joined.withColumns(filled)


def most_frequent(counts: DataFrame, key: str, frequency: str, n: int) -> DataFrame:
    """The n rows of highest frequency, ties by key; ``counts`` should be a written table.

    A top-n merges n rows per task in one place, so on a long table only rows
    above a frequency that leaves enough of them take part.
    """
    rows = counts.count()
    if rows > 20 * n:
        cut = counts.agg(F.approx_percentile(frequency, F.lit(1 - 2 * n / rows), F.lit(100_000))).first()[0]
        high = counts.filter(F.col(frequency) >= cut)
        counts = high if high.count() >= n else counts
    return counts.orderBy(F.col(frequency).desc(), key).limit(n)


def frequent_first_lookup(
    rows: DataFrame, table: DataFrame, key: str, frequency: str, row_id: str, head_rows: int = 50_000
) -> DataFrame:
    """Left lookup of token-like keys whose frequencies are known, such as words in a vocabulary.

    The ``head_rows`` most frequent keys hold every hot key; they are joined
    first, by broadcast when their written size passes the planner's check.
    Only rows still open are shuffled, to the rest of the table, where no key is hot;
    answered rows stay in their task, so that an aggregate that follows starts there.
    ``rows`` is evaluated once for either kind: write it first when it is costly.
    """
    values = [c for c in table.columns if c not in (key, frequency)]
    table = stage(table, "lookup")
    if table.count() <= head_rows:
        return rows.join(table.drop(frequency), key, "left")
    head = stage(most_frequent(table, key, frequency, head_rows), "lookup-head").drop(frequency)
    tail = table.drop(frequency).join(head.select(key), key, "left_anti")
    # Rows without a key have no answer anywhere; they stay too.
    answered = rows.join(head.withColumn("_in_head", F.lit(True)), key, "left").where(F.col("_in_head") | F.col(key).isNull()).drop("_in_head")
    rest = rows.where(F.col(key).isNotNull()).join(head.select(key), key, "left_anti").join(tail, key, "left")
    return answered.select(key, *[c for c in rows.columns if c != key], *values).unionByName(rest)
