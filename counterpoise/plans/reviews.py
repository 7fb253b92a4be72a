"""The review study as compositions of operators: raw tables, features, weights, training rows, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions import features as fx
from counterpoise.functions.numeric import LOGIT_SHIFT
from counterpoise.operators import columns as cx
from counterpoise.operators import ipw, lookup, metrics, propensity, reports, synthetic, text, weights
from counterpoise.operators.splits import assign_split
from counterpoise.plans.fixtures import DOCS_SQL, table, u_sql, weighted_documents, words_sql
from counterpoise.plans.registry import query, rounded
from counterpoise.session import scratch_path, settled, stage
from counterpoise.sources.readers import PRODUCT_SCHEMA, REVIEW_SCHEMA, read_json_by_file, read_json_lines

# Fixed columns of the study.
BASELINE = ["title_length", "description_length", "image_count", "video_count", "details_length"]
SPECS = {"right": "ipw_right", "wrong": "ipw_wrong"}
ALL_WEIGHTS = [
    "ipw_right", "ipw_wrong", "gcomp_right", "gcomp_wrong", "aipw_ipw_right_out_right", "aipw_ipw_right_out_wrong",
    "aipw_ipw_wrong_out_right", "aipw_ipw_wrong_out_wrong",
]


def review_features(
    reviews: DataFrame, products: DataFrame, dictionary: DataFrame, unit_id: str = "unit_id", keys: Sequence[str] = ("parent_asin",)
) -> DataFrame:
    """Feature table: sorted category indicators, product features, treatment flag, outcomes; keeps the row key.

    Product text is reduced to its lengths before the join, so only five
    integers per product are shuffled. Reviews of one popular product are
    spread over tasks. Rows of unknown category are dropped.
    """
    slim = products.select(
        *keys, fx.text_length("title").alias("title_length"), fx.joined_length("description").alias("description_length"),
        fx.array_count("images").alias("image_count"), fx.array_count("videos").alias("video_count"),
        fx.map_text_length("details").alias("details_length"),
    )
    facts = reviews.select(unit_id, *dict.fromkeys([*keys, "parent_asin"]), "verified_purchase", "rating", "title", "text")
    known = lookup.lookup_category(facts, dictionary.select(F.col("key").alias("parent_asin"), "category"), "parent_asin", unit_id)
    known = known.filter(F.col("category") != fx.UNKNOWN)
    joined = lookup.salted_join(known, slim, keys, unit_id, "left").na.fill(0, subset=BASELINE)
    values = cx.category_list(dictionary)
    encoded = cx.one_hot(joined, "category", values)
    return encoded.select(
        unit_id, "category", *cx.columns_with_prefix(encoded, ["category_"]), *BASELINE, "verified_purchase", "rating", "title", "text"
    )


def scored_splits(features: DataFrame, indicators: Sequence[str], shift: float = LOGIT_SHIFT) -> tuple[PipelineModel, DataFrame]:
    """Logistic propensity fitted on the propensity split; the other splits with the shifted probability."""
    names = [*BASELINE, *sorted(indicators)]
    model = propensity.fit_logistic(features.filter("split = 'propensity'"), names, "verified_purchase")
    rest = features.filter("split <> 'propensity'")
    return model, propensity.score_shifted(model, rest, "verified_purchase_prob", shift)


def semi_synthetic_reviews(scored: DataFrame, unit_id: str = "unit_id", seed: int = 42) -> DataFrame:
    """Truly verified rows with a synthetic treatment; outcomes hidden where untreated, except in the test split."""
    text_columns = ("title", "text")
    flagged = scored.withColumn("_verified", F.coalesce(F.col("verified_purchase").cast("int"), F.lit(0)))
    train = synthetic.semi_synthetic(flagged.filter("split <> 'test'"), "verified_purchase_prob", "_verified", unit_id, seed, text_columns)
    test = synthetic.semi_synthetic(flagged.filter("split = 'test'"), "verified_purchase_prob", "_verified", unit_id, seed, keep_outcomes=True)
    return train.unionByName(test).drop("_verified").withColumnRenamed("s_synthetic", "s")


def starred_reviews(df: DataFrame) -> DataFrame:
    """Rows with a valid rating, their text prefixed with it."""
    return cx.with_valid_rating(df).withColumn("text", fx.star_prefixed("rating", "text"))


def review_weights(
    df: DataFrame, indicators: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], PipelineModel], k: int = 200, **options
) -> DataFrame:
    """All eight weights of the two training halves: boosted propensities, stabilised, then augmented."""
    halves = df.filter(F.col("split").isin("half_a", "half_b")).withColumn("fold", F.when(F.col("split") == "half_a", 0).otherwise(1))
    out = stage(propensity.complete_rows(halves, BASELINE), "halves")
    for name, names in propensity.specification([*BASELINE, *indicators], indicators).items():
        scored = propensity.crossfit_scores(out, lambda half, names=names: fit(half, names), out=f"_p_{name}")
        out = scored.withColumn(f"_f_{name}", propensity.inverse(f"_p_{name}"))
    weighted = ipw.stabilized_many(out, {w: f"_f_{n}" for n, w in SPECS.items()})
    weighted = stage(weighted.drop(*[f"_{x}_{n}" for x in "pf" for n in SPECS]), "weighted")
    return weights.augmented_weights(weighted, k, BASELINE, SPECS, block="category", **options)


def training_rows(weighted: DataFrame, size: int = 32_000, length: int = text.MAX_LENGTH, unit_id: str = "unit_id") -> DataFrame:
    """Treated rows as padded token ids with all weights."""
    rows = text.training_table(weighted, ALL_WEIGHTS, required=("title", "text", "rating"), unit_id=unit_id)
    coded = text.encode(rows, text.vocabulary(rows, size=size), unit_id, length=length)
    return coded.join(rows.select(unit_id, *ALL_WEIGHTS), unit_id)


def evaluate_weightings(
    train: DataFrame, test: DataFrame, names: Sequence[str], *, rating: str = "rating", cluster: str = "cluster"
) -> DataFrame:
    """One row per weighting: mean perplexity of the test text, divergence score, frontier integral, rating distance.

    All weightings share one pass over the training text, one over the test
    text and one per histogram.
    """
    models = text.unigram_table(train, names)
    scores = text.perplexities(test, models, names)
    wide = scores.agg(*[F.avg(f"perplexity_{w}").alias(w) for w in names])
    long = lambda df, metric, value: df.select("weight", F.lit(metric).alias("metric"), F.col(value).alias("value"))
    by_weight = wide.select(F.inline(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(w).alias("value")) for w in names])))
    histograms = metrics.weighted_histograms(train, test, cluster, names)
    pmfs = reports.counterfactual_pmf(train, names, rating)
    frames = [
        long(by_weight, "perplexity", "value"),
        long(metrics.curve_area(metrics.divergence_curve(histograms, by=["weight"]), ["weight"]), "score", "score"),
        long(metrics.frontier_integral(histograms, ["weight"]), "frontier_integral", "frontier_integral"),
        long(metrics.wasserstein(pmfs, reports.rating_pmf(test, rating), ["weight"]), "wasserstein", "wasserstein"),
    ]
    return metrics.metric_table(frames, ["perplexity", "score", "frontier_integral", "wasserstein"])


# Registered on tables shaped like the raw files: documents are reviews, nations the products they are about.


def _raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    reviews = docs.select(
        (1 + F.col("n_chars") % 5).cast("float").alias("rating"), F.concat_ws(" ", "source", "lang").alias("title"), "text",
        F.col("source").alias("parent_asin"), F.col("doc_id").cast("string").alias("user_id"), (F.col("quality") == 1).alias("verified_purchase"),
    )
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.concat(F.lit("src"), F.col("n_nationkey"))
    images = F.array_repeat(F.create_map(F.lit("large"), F.col("n_name")), F.col("n_regionkey"))
    products = nation.select(
        key.alias("parent_asin"), F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("title"),
        F.when(F.col("n_regionkey") != 2, F.array("n_name", F.lit("of"), "n_name")).alias("description"),
        F.when(F.col("n_regionkey") != 3, images).alias("images"), images.alias("videos"),
        F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string")).alias("details"),
    )
    dictionary = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'AFRICA'").select(
        key.alias("key"), F.col("r_name").alias("category")
    )
    paths = [scratch_path(spark, "raw-reviews"), scratch_path(spark, "raw-products")]
    reviews.write.json(paths[0])
    products.write.json(paths[1])
    back = read_json_lines(spark, paths[0], REVIEW_SCHEMA).withColumn("unit_id", F.col("user_id").cast("bigint"))
    return back, read_json_lines(spark, paths[1], PRODUCT_SCHEMA), dictionary


_FEATURES = f"""f AS (SELECT d.doc_id AS unit_id, r_name AS category,
  CAST(CASE WHEN n_regionkey<>1 THEN length(n_name) ELSE 0 END AS INT) AS title_length, CAST(CASE WHEN n_regionkey<>2 THEN 2*length(n_name)+4 ELSE 0 END AS INT) AS description_length,
  CAST(CASE WHEN n_regionkey<>3 THEN n_regionkey ELSE 0 END AS INT) AS image_count, CAST(n_regionkey AS INT) AS video_count,
  CAST(8+1+length(n_name)+1+length(CAST(n_nationkey AS VARCHAR)) AS INT) AS details_length,
  quality=1 AS verified_purchase, CAST(1+n_chars%5 AS INT) AS rating, source||' '||lang AS title, text
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id JOIN nation ON source='src'||n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'AFRICA')"""


@query(f"""WITH {_FEATURES} SELECT unit_id, category, {', '.join(f"CASE WHEN category='{r}' THEN 1 ELSE 0 END AS category_{r.lower().replace(' ', '_')}" for r in ('AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))},
title_length, description_length, image_count, video_count, details_length, CAST(verified_purchase AS INT) AS verified, rating, title, md5(text) AS digest FROM f""")
def review_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    out = review_features(*_raw(spark, sf))
    return out.withColumns(
        {"verified": F.col("verified_purchase").cast("int"), "rating": F.col("rating").cast("int"), "digest": F.md5("text")}
    ).drop("verified_purchase", "text")


@query("""SELECT d.doc_id AS unit_id, r_name AS category, CAST(CASE WHEN n_regionkey=1 THEN 0 WHEN lang='en' THEN length(n_name) WHEN lang='fr' THEN length(n_name)+3 ELSE 0 END AS INT) AS title_length
FROM documents d JOIN nation ON source='src'||n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'AFRICA'""")
def review_features_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of category files: a product that stands in two of them joins the reviews of its own file only, and never fans out."""
    reviews, products, dictionary = _raw(spark, sf)
    languages = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), "lang")
    paths = [scratch_path(spark, "file-reviews"), scratch_path(spark, "file-products")]
    reviews.join(languages, "unit_id").drop("unit_id").write.partitionBy("lang").json(paths[0])
    renamed = products.withColumn("title", F.concat("title", F.lit(" fr")))
    products.withColumn("lang", F.lit("en")).unionByName(renamed.withColumn("lang", F.lit("fr"))).write.partitionBy("lang").json(paths[1])
    folder = {"folder_pattern": "lang=([^/]+)/"}
    back = read_json_by_file(spark, f"{paths[0]}/lang=*", REVIEW_SCHEMA, **folder).withColumn("unit_id", F.col("user_id").cast("bigint"))
    by_file = read_json_by_file(spark, f"{paths[1]}/lang=*", PRODUCT_SCHEMA, **folder)
    out = review_features(back, by_file, dictionary, keys=("file_category", "parent_asin"))
    return out.select("unit_id", "category", "title_length")


@query()
def review_study(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files to training rows in one go; reported as the summary of all weights. Only this report stays written."""
    return settled(spark, lambda: _study(spark, sf), "review-study")


def _study(spark: SparkSession, sf: str) -> DataFrame:
    features = stage(assign_split(review_features(*_raw(spark, sf))), "features")
    indicators = cx.columns_with_prefix(features, ["category_"])
    # The study's shift suits flags that are nearly always set; these are set for a fifth of the rows.
    _, scored = scored_splits(features, indicators, shift=3.0)
    made = stage(starred_reviews(semi_synthetic_reviews(scored)), "starred")
    # Boosted propensities, neighbours and vocabulary as the operators have them.
    weighted = stage(review_weights(made, indicators, lambda half, names: propensity.fit_boosted(half, names, "s")), "review-weights")
    rows = training_rows(weighted)
    return reports.weight_summary(rows, ALL_WEIGHTS)


_EVAL_NAMES = ("naive", "w_right", "w_wrong")


def _evaluation_sql() -> str:
    lm = "c AS (SELECT token, " + ", ".join(f"sum({w}) AS c_{w}" for w in _EVAL_NAMES) + f" FROM (SELECT {', '.join(_EVAL_NAMES)}, unnest({words_sql('text')}) AS token FROM t) GROUP BY token)"
    tot = "tot AS (SELECT " + ", ".join(f"sum(c_{w})+count(*)+1 AS b_{w}" for w in _EVAL_NAMES) + " FROM c)"
    ppl = "ppl AS (SELECT unit_id, " + ", ".join(f"exp(-avg(ln((coalesce(c_{w},0)+1)/b_{w}))) AS {w}" for w in _EVAL_NAMES)
    ppl += f" FROM (SELECT unit_id, unnest({words_sql('text')}) AS token FROM d) e LEFT JOIN c ON e.token=c.token CROSS JOIN tot GROUP BY unit_id)"
    parts = []
    for w in _EVAL_NAMES:
        parts.append(f"""SELECT '{w}' AS weight, (SELECT avg({w}) FROM ppl) AS perplexity,
  (SELECT sum(piece) FROM (SELECT (x-lag(x) OVER (ORDER BY x, y DESC))*(y+lag(y) OVER (ORDER BY x, y DESC))/2 AS piece FROM
    (SELECT exp(-5*sum(CASE WHEN q>0 THEN q*ln(q/r) ELSE 0 END)) AS x, exp(-5*sum(CASE WHEN p>0 THEN p*ln(p/r) ELSE 0 END)) AS y FROM
      (SELECT point, p, q, (1e-6+point*(1-2e-6)/24)*p+(1-(1e-6+point*(1-2e-6)/24))*q AS r FROM h_{w}, (SELECT unnest(range(0,25)) AS point)) GROUP BY point
     UNION ALL SELECT 1.0, 0.0 UNION ALL SELECT 0.0, 1.0))) AS score,
  (SELECT 2*sum(CASE WHEN p=q THEN 0 WHEN p=0 THEN q/4 WHEN q=0 THEN p/4 ELSE (p+q)/4-p*q*(ln(p)-ln(q))/(2*(p-q)) END) FROM h_{w}) AS frontier_integral,
  (SELECT sum(abs(g)) FROM (SELECT rating, sum(q-p) OVER (ORDER BY rating) AS g FROM
    (SELECT rating, (SELECT coalesce(sum({w}),0) FROM t WHERE t.rating=r.rating)/(SELECT sum({w}) FROM t) AS q, (SELECT count(*) FROM d WHERE d.rating=r.rating)/(SELECT count(*)::DOUBLE FROM d) AS p
     FROM (SELECT unnest([1,2,3,4,5]) AS rating) r)) WHERE rating<5) AS wasserstein""")
    hist = ", ".join(
        f"h_{w} AS (SELECT a.cluster, n/(SELECT count(*)::DOUBLE FROM d) AS p, coalesce(m,0)/(SELECT sum({w}) FROM t) AS q FROM (SELECT cluster, count(*) AS n FROM d GROUP BY 1) a LEFT JOIN (SELECT cluster, sum({w}) AS m FROM t GROUP BY 1) b ON a.cluster=b.cluster)"
        for w in _EVAL_NAMES)
    return f"""WITH {DOCS_SQL}, d AS (SELECT docs.*, source AS cluster, CAST(1+n_chars%5 AS INT) AS rating, 1.0::DOUBLE AS naive FROM docs JOIN documents ON unit_id=doc_id),
t AS (SELECT * REPLACE (coalesce(w_wrong,0) AS w_wrong) FROM d WHERE s=1), {lm}, {tot}, {ppl}, {hist}
SELECT weight, round(perplexity,4) AS perplexity, round(score,6) AS score, round(frontier_integral,6) AS frontier_integral, round(wasserstein,6) AS wasserstein FROM ({' UNION ALL '.join(parts)})"""


@query(_evaluation_sql())
def evaluation_table(spark: SparkSession, sf: str) -> DataFrame:
    extra = table(spark, sf, "documents").select(
        F.col("doc_id").alias("unit_id"), F.col("source").alias("cluster"), (1 + F.col("n_chars") % 5).cast("int").alias("rating")
    )
    docs = weighted_documents(spark, sf).join(extra, "unit_id").withColumns({"naive": F.lit(1.0), "w_wrong": F.coalesce("w_wrong", F.lit(0.0))})
    out = evaluate_weightings(cx.treated(docs), docs, _EVAL_NAMES)
    return out.select(
        "weight", rounded("perplexity", 4).alias("perplexity"),
        *[rounded(c).alias(c) for c in ("score", "frontier_integral", "wasserstein")],
    )
