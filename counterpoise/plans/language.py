"""Queries on text, language statistics and distribution distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.operators import columns as cx
from counterpoise.operators import metrics, reports, text
from counterpoise.plans.fixtures import DOCS_SQL, WEIGHTED_SQL, table, weighted_documents, weighted_units, words_sql
from counterpoise.plans.registry import query, rounded
from counterpoise.session import stage

_W = ["w_right", "w_wrong"]
_SIZE = 32_000


def _vocab_sql(source: str = "docs", where: str = "") -> str:
    return f"""vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token)+1 AS INT) AS token_id FROM
(SELECT token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS token FROM {source} {where}) GROUP BY token) ORDER BY n DESC, token LIMIT {_SIZE})"""


@query(f"WITH {DOCS_SQL}, {_vocab_sql()} SELECT token, n, token_id FROM vocab")
def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return text.vocabulary(table(spark, sf, "documents"), size=_SIZE)


@query(f"""WITH {DOCS_SQL}, {_vocab_sql()}, cut AS (SELECT unit_id, list_slice({words_sql('text')},1,192) AS t FROM docs),
e AS (SELECT unit_id, unnest(t) AS token, unnest(range(1,len(t)+1)) AS pos FROM cut),
c AS (SELECT unit_id, list(CAST(coalesce(token_id,1) AS INT) ORDER BY pos) AS ids FROM e LEFT JOIN vocab ON e.token=vocab.token GROUP BY unit_id),
full_ids AS (SELECT cut.unit_id, coalesce(ids, CAST([] AS INT[])) AS ids FROM cut LEFT JOIN c ON cut.unit_id=c.unit_id)
SELECT unit_id, array_to_string(list_resize(ids,192,0),' ') AS input_ids, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_resize(CAST([] AS INT[]),192-len(ids),0)),' ') AS attention_mask FROM full_ids""")
def token_encode(spark: SparkSession, sf: str) -> DataFrame:
    docs = weighted_documents(spark, sf)
    out = text.encode(docs, text.vocabulary(docs, size=_SIZE))
    # Joined only to be compared; the operator gives arrays.
    return out.select("unit_id", *[F.concat_ws(" ", F.col(c).cast("array<string>")).alias(c) for c in ("input_ids", "attention_mask")])


@query(f"""SELECT count(*) AS rows, round(avg(n),6) AS mean, quantile_cont(n,0.5)::DOUBLE AS median, quantile_cont(n,0.95)::DOUBLE AS p95, CAST(max(n) AS INT) AS max
FROM (SELECT least(len({words_sql('text')}),192) AS n FROM documents)""")
def token_lengths(spark: SparkSession, sf: str) -> DataFrame:
    lengths = table(spark, sf, "documents").select(text.token_length("text").alias("n"))
    return text.length_statistics(lengths, "n").withColumn("mean", rounded("mean"))


@query(f"""WITH {DOCS_SQL} SELECT unit_id, md5(text) AS digest, round(w_right,6) AS w_right, round(w_wrong,6) AS w_wrong FROM docs
WHERE s=1 AND text IS NOT NULL""")
def training_table(spark: SparkSession, sf: str) -> DataFrame:
    out = text.training_table(weighted_documents(spark, sf), _W)
    return out.select("unit_id", F.md5("text").alias("digest"), rounded("w_right").alias("w_right"), rounded("w_wrong").alias("w_wrong"))


@query(f"""WITH {DOCS_SQL}, t AS (SELECT * FROM docs WHERE s=1),
a AS (SELECT 'naive' AS choice, unit_id, 1.0::DOUBLE AS weight FROM t UNION ALL SELECT 'w_right', unit_id, w_right FROM t UNION ALL SELECT 'w_wrong', unit_id, w_wrong FROM t)
SELECT choice, unit_id, round(weight,6) AS weight FROM a WHERE weight<>0""")
def weight_select(spark: SparkSession, sf: str) -> DataFrame:
    base = text.training_table(weighted_documents(spark, sf), _W)
    frames = [
        cx.nonzero_weight(cx.choose_weight(base, name, _W), "weight").select(F.lit(name).alias("choice"), "unit_id", rounded("weight").alias("weight"))
        for name in ("naive", *_W)
    ]
    return cx.concat_by_name(*frames)


def _unigram_sql(name: str, weight: str, where: str) -> str:
    return f"""{name}_c AS (SELECT token, sum(w) AS c, count(*) AS n FROM (SELECT {weight} AS w, unnest({words_sql('text')}) AS token FROM docs WHERE {where}) GROUP BY token),
{name}_t AS (SELECT sum(c)+count(*)+1 AS below FROM {name}_c),
{name} AS (SELECT token, n, c, (c+1)/below AS p, 1.0/below AS p_unknown FROM {name}_c, {name}_t)"""


@query(f"WITH {DOCS_SQL}, {_unigram_sql('lm', 'w_right', 's=1')} SELECT token, n, round(c,6) AS c, round(p,9) AS p, round(p_unknown,9) AS p_unknown FROM lm")
def weighted_unigram_lm(spark: SparkSession, sf: str) -> DataFrame:
    lm = text.weighted_unigrams(cx.treated(weighted_documents(spark, sf)), "w_right")
    return lm.withColumns({"c": rounded("c"), "p": rounded("p", 9), "p_unknown": rounded("p_unknown", 9)})


def _bigram_sql(weight: str) -> str:
    return f"""WITH {DOCS_SQL}, t AS (SELECT coalesce({weight},0) AS w, {words_sql('text')} AS t FROM docs WHERE s=1),
g AS (SELECT w, unnest(t[1:len(t)-1]) AS previous, unnest(t[2:len(t)]) AS token FROM t WHERE len(t)>1),
c AS (SELECT previous, token, sum(w) AS c FROM g GROUP BY 1,2), v AS (SELECT count(DISTINCT token) AS v FROM (SELECT unnest(t) AS token FROM t))
SELECT previous, token, round(c,6) AS c, round((c+1)/(sum(c) OVER (PARTITION BY previous)+v),9) AS p FROM c, v"""


def _bigrams(spark: SparkSession, sf: str, weight: str) -> DataFrame:
    lm = text.weighted_bigrams(cx.treated(weighted_documents(spark, sf)), weight)
    return lm.withColumns({"c": rounded("c"), "p": rounded("p", 9)})


@query(_bigram_sql("w_right"))
def weighted_bigram_lm(spark: SparkSession, sf: str) -> DataFrame:
    return _bigrams(spark, sf, "w_right")


@query(_bigram_sql("w_wrong"))
def weighted_bigram_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """With weights that are null in some rows: their pairs count 0."""
    return _bigrams(spark, sf, "w_wrong")


def _perplexity(spark: SparkSession, sf: str, weight: str | None) -> DataFrame:
    docs = weighted_documents(spark, sf)
    return text.document_perplexity(docs, text.weighted_unigrams(cx.treated(docs), weight))


def _perplexity_sql(name: str, weight: str, where: str = "s=1") -> str:
    return f"""{_unigram_sql(name, weight, where)},
{name}_ppl AS (SELECT unit_id, exp(-avg(ln(coalesce(p,(SELECT any_value(p_unknown) FROM {name}))))) AS perplexity, count(*) AS tokens
  FROM (SELECT unit_id, unnest({words_sql('text')}) AS token FROM docs) e LEFT JOIN {name} ON e.token={name}.token GROUP BY unit_id)"""


@query(f"WITH {DOCS_SQL}, {_perplexity_sql('lm', 'w_right')} SELECT unit_id, round(perplexity,4) AS perplexity, tokens FROM lm_ppl")
def doc_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return _perplexity(spark, sf, "w_right").withColumn("perplexity", rounded("perplexity", 4))


def _backoff_sql(weight: str) -> str:
    return f"""WITH {DOCS_SQL}, {_unigram_sql('lm', f'coalesce({weight},0)', 's=1')}, t AS (SELECT coalesce({weight},0) AS w, {words_sql('text')} AS t FROM docs WHERE s=1),
g AS (SELECT w, unnest(t[1:len(t)-1]) AS previous, unnest(t[2:len(t)]) AS token FROM t WHERE len(t)>1),
c AS (SELECT previous, token, sum(w) AS c FROM g GROUP BY 1,2), x AS (SELECT previous, sum(c) AS s, count(*) AS f FROM c GROUP BY 1),
l AS (SELECT unit_id, {words_sql('text')} AS t FROM docs), e AS (SELECT unit_id, unnest(t) AS token, unnest(list_concat([NULL], t[1:len(t)-1])) AS previous FROM l WHERE len(t)>0),
z AS (SELECT e.unit_id, ln(coalesce(c.c/(x.s+x.f),0) + coalesce(x.f/(x.s+x.f),1)*coalesce(lm.p,(SELECT any_value(p_unknown) FROM lm))) AS q
  FROM e LEFT JOIN lm ON lm.token=e.token LEFT JOIN x ON x.previous=e.previous LEFT JOIN c ON c.previous=e.previous AND c.token=e.token)
SELECT d.unit_id, round(exp(-avg(q)),4) AS perplexity, count(q) AS tokens FROM docs d LEFT JOIN z ON z.unit_id=d.unit_id GROUP BY d.unit_id"""


def _backoff(spark: SparkSession, sf: str, weight: str) -> DataFrame:
    docs = weighted_documents(spark, sf)
    out = text.backoff_perplexity(docs, text.backoff_bigrams(cx.treated(docs), weight))
    return out.withColumn("perplexity", rounded("perplexity", 4))


@query(_backoff_sql("w_right"))
def bigram_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return _backoff(spark, sf, "w_right")


@query(_backoff_sql("w_wrong"))
def bigram_perplexity_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """With weights that are null in some rows."""
    return _backoff(spark, sf, "w_wrong")


_EMPTY_DOCS = """docs AS (SELECT unit_id, category, CASE WHEN unit_id%3=0 THEN '' WHEN unit_id%7=0 THEN NULL ELSE text END AS text, s, w_right FROM full_docs)"""


@query(f"WITH {DOCS_SQL.replace('docs AS', 'full_docs AS', 1)}, {_EMPTY_DOCS}, {_perplexity_sql('lm', 'w_right')} "
       "SELECT d.unit_id, round(perplexity,4) AS perplexity, coalesce(tokens,0) AS tokens FROM docs d LEFT JOIN lm_ppl ON lm_ppl.unit_id=d.unit_id")
def perplexity_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without words keep their row."""
    blank = F.when(F.col("unit_id") % 3 == 0, "").when(F.col("unit_id") % 7 == 0, F.lit(None)).otherwise(F.col("text"))
    docs = weighted_documents(spark, sf).withColumn("text", blank)
    out = text.document_perplexity(docs, text.weighted_unigrams(cx.treated(docs), "w_right"))
    return out.withColumn("perplexity", rounded("perplexity", 4))


_NAMES = (("naive", "1.0::DOUBLE", "s=1"), ("w_right", "w_right", "s=1"), ("w_wrong", "coalesce(w_wrong,0)", "s=1"))


@query(f"WITH {DOCS_SQL}, " + ", ".join(_perplexity_sql(n, w, c) for n, w, c in _NAMES) + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS weight, count(*) AS documents, round(avg(perplexity),4) AS mean, round(min(perplexity),4) AS min, round(max(perplexity),4) AS max, round(stddev_pop(perplexity),4) AS std FROM {n}_ppl"
    for n, *_ in _NAMES))
def perplexity_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = weighted_documents(spark, sf).withColumn("naive", F.lit(1.0)), [name for name, *_ in _NAMES]
    # All three models are counted, and all documents scored, in one pass each.
    wide = text.perplexities(docs, text.unigram_table(cx.treated(docs), names), names)
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("weight"), F.col(f"perplexity_{name}").alias("perplexity")) for name in names])))
    out = text.perplexity_summary(long, ["weight"])
    return out.withColumns({c: rounded(c, 4) for c in ("mean", "min", "max", "std")})


@query(f"""WITH {DOCS_SQL}, {_perplexity_sql('lm', 'w_right')} SELECT category, round(sum(w_right*ln(perplexity))/sum(w_right),6) AS weighted_loss
FROM lm_ppl JOIN docs ON docs.unit_id=lm_ppl.unit_id GROUP BY category""")
def weighted_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = _perplexity(spark, sf, "w_right").select("unit_id", F.log("perplexity").alias("loss"))
    rows = weighted_documents(spark, sf).select("unit_id", "category", "w_right").join(loss, "unit_id")
    return text.weighted_loss(rows, "loss", "w_right", ["category"]).withColumn("weighted_loss", rounded("weighted_loss"))


def _pmfs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    w = stage(weighted_units(spark, sf).withColumn("naive", F.col("s").cast("double")), "units")
    return reports.counterfactual_pmf(w, ["naive", "ipw_right", "ipw_wrong"]), reports.rating_pmf(w)


_DISTANCE = f"""WITH {WEIGHTED_SQL}, long AS (SELECT 'naive' AS weight, rating, s::DOUBLE AS w FROM weighted UNION ALL SELECT 'ipw_right', rating, ipw_right FROM weighted
  UNION ALL SELECT 'ipw_wrong', rating, ipw_wrong FROM weighted),
u AS (SELECT weight, r.rating, coalesce(sum(w) FILTER (long.rating=r.rating),0)/sum(w) AS p FROM long CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS rating) r GROUP BY 1,2),
v AS (SELECT r.rating, count(*) FILTER (weighted.rating=r.rating)/count(*)::DOUBLE AS q FROM weighted CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS rating) r GROUP BY 1),
f AS (SELECT weight, u.rating, abs(sum(p-q) OVER (PARTITION BY weight ORDER BY u.rating)) AS gap FROM u JOIN v ON u.rating=v.rating),
dist AS (SELECT weight, sum(gap) FILTER (rating<5) AS wasserstein FROM f GROUP BY weight)"""


@query(_DISTANCE + " SELECT weight, round(wasserstein,6) AS wasserstein FROM dist")
def wasserstein_rating(spark: SparkSession, sf: str) -> DataFrame:
    pmf, target = _pmfs(spark, sf)
    return metrics.wasserstein(pmf, target, ["weight"]).withColumn("wasserstein", rounded("wasserstein"))


@query(_DISTANCE + """, m AS (SELECT weight, sum(rating*p) AS mean_rating, max(p) AS peak FROM u GROUP BY weight)
SELECT m.weight, round(mean_rating,6) AS mean_rating, round(peak,6) AS peak, round(wasserstein,6) AS wasserstein FROM m JOIN dist ON m.weight=dist.weight""")
def metric_table(spark: SparkSession, sf: str) -> DataFrame:
    pmf, target = _pmfs(spark, sf)
    pmf = stage(pmf, "pmf")
    long = lambda df, name, value: df.select("weight", F.lit(name).alias("metric"), value.alias("value"))
    frames = [
        long(pmf.groupBy("weight").agg(F.sum(F.col("rating") * F.col("p")).alias("v")), "mean_rating", F.col("v")),
        long(pmf.groupBy("weight").agg(F.max("p").alias("v")), "peak", F.col("v")),
        long(metrics.wasserstein(pmf, target, ["weight"]), "wasserstein", F.col("wasserstein")),
    ]
    names = ["mean_rating", "peak", "wasserstein"]
    return metrics.metric_table(frames, names).select("weight", *[rounded(n).alias(n) for n in names])


_HIST = """h AS (SELECT label AS cluster, count(*) FILTER (embedding[1]>0)::DOUBLE/(SELECT count(*) FROM embeddings WHERE embedding[1]>0) AS p,
  count(*) FILTER (NOT embedding[1]>0)::DOUBLE/(SELECT count(*) FROM embeddings WHERE NOT embedding[1]>0) AS q FROM embeddings GROUP BY label)"""
_CURVE = f"""WITH {_HIST}, g AS (SELECT CAST(unnest(range(0,25)) AS INT) AS point), r AS (SELECT point, p, q, (1e-6+point*(1-2e-6)/24)*p+(1-(1e-6+point*(1-2e-6)/24))*q AS r FROM h, g),
curve AS (SELECT point, exp(-5*sum(CASE WHEN q>0 THEN q*ln(q/r) ELSE 0 END)) AS x, exp(-5*sum(CASE WHEN p>0 THEN p*ln(p/r) ELSE 0 END)) AS y FROM r GROUP BY point
  UNION ALL SELECT -1, 1.0, 0.0 UNION ALL SELECT 25, 0.0, 1.0)"""


def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").withColumn("in_p", F.get("embedding", F.lit(0)) > 0)
    return metrics.cluster_histogram(vectors, "label", F.col("in_p"))


@query(f"WITH {_HIST} SELECT cluster, round(p,6) AS p, round(q,6) AS q FROM h")
def cluster_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(spark, sf).select("cluster", rounded("p").alias("p"), rounded("q").alias("q"))


@query(_CURVE + " SELECT CAST(point AS INT) AS point, round(x,6) AS x, round(y,6) AS y FROM curve")
def divergence_curve(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.divergence_curve(_histogram(spark, sf)).withColumns({"x": rounded("x"), "y": rounded("y")})


@query(_CURVE + """, a AS (SELECT (x-lag(x) OVER o)*(y+lag(y) OVER o)/2 AS piece FROM curve WINDOW o AS (ORDER BY x, y DESC)),
t AS (SELECT CASE WHEN p=q THEN 0 WHEN p=0 THEN q/4 WHEN q=0 THEN p/4 ELSE (p+q)/4-p*q*(ln(p)-ln(q))/(2*(p-q)) END AS t FROM h)
SELECT round((SELECT sum(piece) FROM a),6) AS score, round(2*sum(t),6) AS frontier_integral FROM t""")
def divergence_frontier(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").withColumn("in_p", F.get("embedding", F.lit(0)) > 0)
    out = metrics.divergence_frontier(vectors, "label", F.col("in_p"))
    return out.select(rounded("score").alias("score"), rounded("frontier_integral").alias("frontier_integral"))


@query("""WITH x AS (SELECT label<5 AS a, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
m AS (SELECT i, avg(x) FILTER (a) AS m1, avg(x) FILTER (NOT a) AS m2, stddev_samp(x) FILTER (a) AS s1, stddev_samp(x) FILTER (NOT a) AS s2 FROM x GROUP BY i)
SELECT round(sum((m1-m2)*(m1-m2)+(s1-s2)*(s1-s2)),6) AS frechet_diagonal FROM m""")
def frechet_diag(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.frechet_diagonal(table(spark, sf, "embeddings"), "embedding", F.col("label") < 5)
    return out.withColumn("frechet_diagonal", rounded("frechet_diagonal"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, CAST(unnest(range(64)) AS INT) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM x GROUP BY i),
c AS (SELECT vec_id, x.i, x-m AS x FROM x JOIN m ON x.i=m.i)
SELECT a.i, b.i AS j, round(sum(a.x*b.x)/((SELECT count(*) FROM embeddings)-1),8)+0.0 AS cov FROM c a JOIN c b ON a.vec_id=b.vec_id GROUP BY 1,2""")
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.covariance(table(spark, sf, "embeddings"), "embedding").withColumn("cov", rounded("cov", 8))


@query("""SELECT label, CAST(i AS INT) AS i, round(avg(x),8)+0.0 AS mean, round(stddev_samp(x),8) AS std FROM
(SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i""")
def feature_moments(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.feature_moments(table(spark, sf, "embeddings"), "embedding", ["label"])
    return out.withColumns({"mean": rounded("mean", 8), "std": rounded("std", 8)})


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, round(sum((1+8*CASE WHEN x>0 THEN 1 ELSE 0 END)*x*x)/sum(1+8*CASE WHEN x>0 THEN 1 ELSE 0 END),8) AS loss FROM x GROUP BY vec_id""")
def region_loss(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    error = F.transform(v, lambda x: x * x)
    mask = F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return table(spark, sf, "embeddings").select("vec_id", rounded(metrics.region_weighted_mean(error, mask), 8).alias("loss"))


@query()
def frechet_full(spark: SparkSession, sf: str) -> DataFrame:
    value = metrics.frechet_within(table(spark, sf, "embeddings"), "embedding", F.col("label") < 5)
    return spark.createDataFrame([(value,)], "frechet double")
