"""Vocabulary, token encoding and weighted language statistics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterpoise.operators.lookup import frequent_first_lookup, most_frequent, salted_join
from counterpoise.session import stage

# Fixed ids; words start after them.
PAD_ID, UNKNOWN_ID, FIRST_WORD_ID = 0, 1, 2
MAX_LENGTH = 192
_BLANKS = r"[ \t\n\r\f]+"


def words(text: str | Column) -> Column:
    """Words between blanks of the whole text; an empty array for null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.filter(F.split(t, _BLANKS), lambda w: w != ""), F.array().cast("array<string>"))


def vocabulary(df: DataFrame, text: str = "text", size: int = 32_000) -> DataFrame:
    """The ``size`` most frequent words with their ids, by count, then alphabetically."""
    counts = df.select(F.explode(words(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = most_frequent(stage(counts, "word-counts"), "token", "n", size)
    # Numbers at most ``size`` rows.
    order = W.orderBy(F.col("n").desc(), F.col("token"))
    return top.select("token", "n", (F.row_number().over(order) + FIRST_WORD_ID - 1).alias("token_id"))


def encode(
    df: DataFrame, vocab: DataFrame, unit_id: str = "unit_id", text: str = "text", length: int = MAX_LENGTH
) -> DataFrame:
    """Ids cut to ``length`` and padded on the right, with the attention mask: ``unit_id, input_ids, attention_mask``.

    The cut happens before the words become rows, so a document adds at most
    ``length`` rows to the shuffle.
    """
    # posexplode_outer keeps documents without a word.
    tokens = df.select(unit_id, F.posexplode_outer(F.slice(words(text), 1, length)).alias("_pos", "token"))
    coded = frequent_first_lookup(tokens, vocab, "token", "n", unit_id)
    entry = F.when(
        F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id"))
    )
    lists = coded.groupBy(unit_id).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    ids = F.transform("_e", lambda e: e["id"])
    used = F.size("_e")
    return lists.select(
        unit_id,
        F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(length) - used)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used)).alias("attention_mask"),
    )


def token_length(text: str | Column, length: int = MAX_LENGTH) -> Column:
    """Number of words after the cut."""
    return F.least(F.size(words(text)), F.lit(length))


def length_statistics(df: DataFrame, length: str) -> DataFrame:
    """Mean, exact median, exact 95th percentile and maximum.

    Percentiles are taken over the distinct lengths with their frequencies, so
    the aggregation state is as large as the range of lengths, not the table.
    """
    counts = df.groupBy(length).agg(F.count(F.lit(1)).alias("_n"))
    at = lambda q: F.percentile(length, F.lit(q), F.col("_n"))
    return counts.agg(
        F.sum("_n").alias("rows"), (F.sum(F.col(length) * F.col("_n")) / F.sum("_n")).alias("mean"),
        at(0.5).alias("median"), at(0.95).alias("p95"), F.max(length).alias("max"),
    )


def training_table(
    df: DataFrame, weights: Sequence[str], treatment: str = "s", required: Sequence[str] = ("text",), unit_id: str = "unit_id"
) -> DataFrame:
    """Treated rows with all required columns present, pruned to those and the weights."""
    return df.filter(F.col(treatment) == 1).na.drop(subset=list(required)).select(unit_id, *required, *weights)


def unigram_table(df: DataFrame, weights: Sequence[str], text: str = "text", alpha: float = 1.0) -> DataFrame:
    """Row-weighted word probabilities under every weight column, counted in one pass over the text.

    ``token, n`` and per weight ``c_<w>, p_<w>, unknown_<w>``. Smoothing adds
    alpha to every type and to one unknown type, so known and unknown
    probabilities sum to 1. A null weight counts as 0.
    """
    tokens = df.select(*[F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(w) for w in weights], F.explode(words(text)).alias("token"))
    counts = stage(
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(f"c_{w}") for w in weights]), "unigrams"
    )
    totals = counts.agg(F.count(F.lit(1)).alias("types"), *[F.sum(f"c_{w}").alias(w) for w in weights]).first()
    out = {}
    for w in weights:
        below = (totals[w] or 0.0) + alpha * (totals["types"] + 1)
        out[f"p_{w}"] = (F.col(f"c_{w}") + alpha) / F.lit(below)
        out[f"unknown_{w}"] = F.lit(alpha / below)
    return counts.withColumns(out)


def weighted_unigrams(df: DataFrame, weight: str | None = None, text: str = "text", alpha: float = 1.0) -> DataFrame:
    """One model: ``token, n, c, p, p_unknown``. As in ``unigram_table`` a null weight counts as 0 and the row's word types stay."""
    rows = df.withColumn("_w", F.lit(1.0) if weight is None else F.col(weight))
    return unigram_table(rows, ["_w"], text, alpha).select(
        "token", "n", F.col("c__w").alias("c"), F.col("p__w").alias("p"), F.col("unknown__w").alias("p_unknown")
    )


def weighted_bigrams(df: DataFrame, weight: str | None = None, text: str = "text", alpha: float = 1.0) -> DataFrame:
    """Row-weighted ``p(token | previous)`` with add-alpha smoothing over the word types.

    A null weight counts as 0, and the row's pairs and word types stay. A word that very many others follow is spread over tasks.
    """
    counts = _pair_counts(df, weight, text)
    types = df.select(F.explode(words(text)).alias("token")).distinct().count()
    context = counts.groupBy("previous").agg(F.sum("c").alias("_context"))
    return salted_join(counts, context, ["previous"], "token", "inner").select(
        "previous", "token", "c", ((F.col("c") + alpha) / (F.col("_context") + alpha * types)).alias("p")
    )


def _pair_counts(df: DataFrame, weight: str | None, text: str) -> DataFrame:
    """``previous, token, c, n``: summed weights and occurrences of neighbouring words."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    pairs = df.select(w.alias("_w"), F.explode(_neighbours(text)).alias("_p")).filter(F.col("_p.previous").isNotNull())
    return stage(
        pairs.groupBy(F.col("_p.previous").alias("previous"), F.col("_p.token").alias("token")).agg(F.sum("_w").alias("c"), F.count(F.lit(1)).alias("n")),
        "bigrams",
    )


def _neighbours(text: str) -> Column:
    """Every word with the one before it, which is null for the first."""
    t = words(text)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))))
    return F.zip_with(F.when(F.size(t) > 0, before).otherwise(t), t, lambda a, b: F.struct(a.alias("previous"), b.alias("token")))


class BackoffModel(NamedTuple):
    """Interpolated bigrams: seen pairs with their probability, contexts with their back-off weight, and the unigrams."""

    pairs: DataFrame
    contexts: DataFrame
    unigrams: DataFrame


def backoff_bigrams(df: DataFrame, weight: str | None = None, text: str = "text", alpha: float = 1.0) -> BackoffModel:
    """Row-weighted bigrams interpolated with the unigrams of ``weighted_unigrams``.

    ``p(token | previous) = c / (C + T) + T / (C + T) * p(token)`` with the context's summed weight C and its T different
    followers, so that a context of many followers trusts its pairs less. Pairs never seen keep the second term, contexts
    never seen the unigram alone. Null weights count 0. ``pairs``: ``previous, token, p``, ``contexts``: ``previous, n, back``.
    """
    unigrams = stage(weighted_unigrams(df, weight, text, alpha), "backoff-unigrams")
    counts = _pair_counts(df, weight, text)
    contexts = stage(
        counts.groupBy("previous").agg(F.sum("n").alias("n"), F.sum("c").alias("_sum"), F.count(F.lit(1)).alias("_followers")), "backoff-contexts"
    )
    below = F.col("_sum") + F.col("_followers")
    # A word that follows many others, and a context of many followers, are answered from the head of either table.
    single = frequent_first_lookup(counts.drop("n"), unigrams.select("token", "n", F.col("p").alias("_single")), "token", "n", "previous")
    joined = frequent_first_lookup(single, contexts, "previous", "n", "token")
    pairs = joined.select("previous", "token", ((F.col("c") + F.col("_followers") * F.col("_single")) / below).alias("p"))
    return BackoffModel(pairs, contexts.select("previous", "n", (F.col("_followers") / below).alias("back")), unigrams)


def backoff_perplexity(df: DataFrame, model: BackoffModel, unit_id: str = "unit_id", text: str = "text") -> DataFrame:
    """``exp(-mean log p)`` of every whole document under the bigrams; its first word goes by the unigrams: ``unit_id, perplexity, tokens``.

    Each different pair of all documents is scored once, unseen ones by their context and word; the documents then look up
    finished scores, the most frequent pairs first. A document without words stays, with 0 tokens and a null perplexity.
    """
    first = model.unigrams.select("p_unknown").first()
    unknown = F.lit(float(first[0]) if first else 1.0)
    asked = df.select(F.explode(_neighbours(text)).alias("_p")).groupBy(F.col("_p.previous").alias("previous"), F.col("_p.token").alias("token"))
    scored = stage(asked.agg(F.count(F.lit(1)).alias("_asked")).join(model.pairs, ["previous", "token"], "left"), "backoff-pairs")
    # Only unseen pairs and first words are looked up; the latter have no context.
    open_ = frequent_first_lookup(scored.where(F.col("p").isNull()).drop("p"), model.contexts, "previous", "n", "token")
    open_ = frequent_first_lookup(open_, model.unigrams.select("token", "n", F.col("p").alias("_single")), "token", "n", "previous")
    names = ["previous", "token", "_asked"]
    unseen = open_.select(*names, (F.coalesce("back", F.lit(1.0)) * F.coalesce("_single", unknown)).alias("p"))
    scored = scored.where(F.col("p").isNotNull()).select(*names, "p").unionByName(unseen)
    # Words hold no newline, so it parts them; the first word of a text has nothing before it.
    pair = F.concat(F.coalesce("previous", F.lit("")), F.lit("\n"), "token").alias("_pair")
    table = scored.select(pair, F.col("_asked").alias("n"), F.log("p").alias("_log"))
    rows = df.select(unit_id, F.explode_outer(_neighbours(text)).alias("_p")).select(unit_id, "_p.previous", "_p.token").select(unit_id, pair)
    found = frequent_first_lookup(rows, table, "_pair", "n", unit_id)
    # Every pair has a score, so the scores tell how many words there are.
    return found.groupBy(unit_id).agg(F.exp(-F.avg("_log")).alias("perplexity"), F.count("_log").alias("tokens"))


def perplexities(
    df: DataFrame, models: DataFrame, weights: Sequence[str], unit_id: str = "unit_id", text: str = "text"
) -> DataFrame:
    """``exp(-mean log p)`` over the words of each whole document, one column per model: the text is read once.

    A document without words stays, with 0 tokens and null perplexities.
    """
    unknown = models.select(*[f"unknown_{w}" for w in weights]).first()
    tokens = df.select(unit_id, F.explode_outer(words(text)).alias("token"))
    scored = frequent_first_lookup(tokens, models.select("token", "n", *[f"p_{w}" for w in weights]), "token", "n", unit_id)
    out = []
    for w in weights:
        p = F.when(F.col("token").isNotNull(), F.coalesce(f"p_{w}", F.lit(float(unknown[f"unknown_{w}"]) if unknown else 1.0)))
        out.append(F.exp(-F.avg(F.log(p))).alias(f"perplexity_{w}"))
    return scored.groupBy(unit_id).agg(F.count("token").alias("tokens"), *out)


def document_perplexity(df: DataFrame, model: DataFrame, unit_id: str = "unit_id", text: str = "text") -> DataFrame:
    """Perplexity of each document under one model: ``unit_id, perplexity, tokens``."""
    models = model.select("token", "n", F.col("p").alias("p__w"), F.col("p_unknown").alias("unknown__w"))
    return perplexities(df, models, ["_w"], unit_id, text).select(unit_id, F.col("perplexity__w").alias("perplexity"), "tokens")


def perplexity_summary(perplexities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Arithmetic mean, minimum, maximum and population deviation over documents."""
    x = "perplexity"
    return perplexities.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.stddev_pop(x).alias("std"),
    )


def weighted_loss(df: DataFrame, loss: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """``sum(w * loss) / sum(w)`` over rows."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(weight) * F.col(loss)), F.sum(weight)).alias("weighted_loss"))
