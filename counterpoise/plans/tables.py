"""Queries on features, lookups, splits, summaries and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions import features as fx
from counterpoise.functions import numeric as nx
from counterpoise.functions.hashing import row_key
from counterpoise.operators import columns as cx
from counterpoise.operators import lookup, reports, splits
from counterpoise.plans.fixtures import DOCS_SQL, UNITS_SQL, labelled_documents, table, u_sql, units, weighted_documents
from counterpoise.plans.registry import query, rounded as r6

@query("""SELECT doc_id AS unit_id, CAST(coalesce(length(t),0) AS INT) AS text_length, CAST(coalesce(len(string_split(t,' ')),0) AS INT) AS piece_count,
  CAST(coalesce(length(array_to_string(string_split(t,' '),' ')),0) AS INT) AS joined_length
FROM (SELECT d.doc_id, CASE WHEN quality=1 THEN text END AS t FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)""")
def feat_lengths(spark: SparkSession, sf: str) -> DataFrame:
    docs = labelled_documents(spark, sf).select("doc_id", F.when(F.col("quality") == 1, F.col("text")).alias("t"))
    pieces = F.split("t", " ")
    return docs.select(
        F.col("doc_id").alias("unit_id"), fx.text_length("t").alias("text_length"),
        fx.array_count(pieces).alias("piece_count"), fx.joined_length(pieces).alias("joined_length"),
    )


@query("""SELECT event_id AS unit_id, CAST(CASE WHEN event_type='error' THEN 0 ELSE
  length(array_to_string(list_concat(json_keys(props), list_transform(json_keys(props), lambda k: json_extract_string(props,'$.'||k))),' ')) END AS INT) AS details_length
FROM events""")
def map_lengths(spark: SparkSession, sf: str) -> DataFrame:
    props = F.when(F.col("event_type") != "error", F.from_json("props", "map<string,string>"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("unit_id"), fx.map_text_length(props).alias("details_length")
    )


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter(F.col("r_name") != "AFRICA").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("category")
    )


@query("""SELECT c_custkey AS unit_id, r_name AS category, """ + ", ".join(
    f"CASE WHEN r_name='{r}' THEN 1 ELSE 0 END AS category_{r.lower().replace(' ', '_')}" for r in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
) + """ FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'AFRICA'""")
def onehot_category(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = _regions(spark, sf)
    values = cx.category_list(dictionary)
    found = lookup.lookup_category(table(spark, sf, "customer"), dictionary, "c_nationkey", "c_custkey")
    encoded = cx.one_hot(found, "category", values)
    return encoded.select(
        F.col("c_custkey").alias("unit_id"), "category", *cx.columns_with_prefix(encoded, ["category_"])
    )


@query("""SELECT d.doc_id AS unit_id, coalesce(CASE WHEN toxic=1 THEN 'toxic' WHEN toxic=0 THEN 'clean' END,'Unknown') AS category
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("category"))
    found = lookup.lookup_category(table(spark, sf, "documents").select("doc_id"), dictionary, "doc_id", "doc_id")
    return found.select(F.col("doc_id").alias("unit_id"), "category")


@query("""SELECT e.event_id AS unit_id, e.user_id, c.c_mktsegment AS category, c.c_acctbal AS x2 FROM events e LEFT JOIN customer c ON e.user_id=c.c_custkey""")
def lookup_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_id").alias("unit_id"), "user_id")
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("x2")
    )
    return lookup.salted_join(events, customer, ["user_id"], "unit_id", "left", rows_per_task=20).select(
        "unit_id", "user_id", "category", "x2"
    )


@query("""SELECT d.doc_id AS unit_id, turn, role FROM documents d LEFT JOIN conversations c ON d.doc_id=c.conv_id""")
def left_join_fanout(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("unit_id"), "turn", "role")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"))
    return lookup.salted_join(docs, turns, ["unit_id"], "unit_id", "left")


@query("""SELECT lang AS category, count(*) AS rows, CAST(sum(CASE WHEN quality=1 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS labelled,
  count(*) FILTER (quality IS NULL) AS removed, count(quality) AS kept, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS complete
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id GROUP BY lang""")
def label_encode_nulls(spark: SparkSession, sf: str) -> DataFrame:
    docs = labelled_documents(spark, sf).withColumn("rating", F.col("quality").cast("float"))
    present = fx.present("rating")
    return docs.groupBy(F.col("lang").alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(fx.flag_label("quality")).alias("labelled"),
        F.count_if(~present).alias("removed"), F.count_if(present).alias("kept"),
        F.count_if(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("complete"),
    )


@query("""SELECT lang AS category, count(*) AS rows, CAST(sum(quality) AS BIGINT) AS good FROM documents d JOIN labels l ON d.doc_id=l.doc_id GROUP BY lang""")
def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept = cx.with_valid_rating(labelled_documents(spark, sf).na.drop(subset=["quality", "toxic"]), "quality")
    return kept.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("rows"), F.sum("quality").alias("good"))


@query("SELECT doc_id, quality, toxic FROM labels")
def recode_pm1(spark: SparkSession, sf: str) -> DataFrame:
    signed = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") * 2 - 1).alias("quality"), (F.col("toxic") * 2 - 1).alias("toxic")
    )
    return cx.recode_plus_minus_one(signed, cx.plus_minus_one_columns(signed))


@query("""SELECT doc_id AS unit_id, md5(CAST(r AS VARCHAR)||CASE WHEN r=1 THEN ' star: ' ELSE ' stars: ' END||text) AS digest
FROM (SELECT doc_id, text, CAST(1+n_chars%5 AS INT) AS r FROM documents)""")
def star_prefix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("rating", (1 + F.col("n_chars") % 5).cast("float"))
    return docs.select(F.col("doc_id").alias("unit_id"), F.md5(fx.star_prefixed("rating", "text")).alias("digest"))


@query("""WITH t AS (SELECT o_orderstatus AS status, CASE WHEN regexp_matches(o_orderpriority,'^[1-5]') THEN CAST(substr(o_orderpriority,1,1) AS INT) END AS rating FROM orders
  UNION ALL SELECT role AS status, CASE WHEN regexp_matches(text,'^[1-5]') THEN CAST(substr(text,1,1) AS INT) END AS rating FROM conversations),
n AS (SELECT status, count(*) AS rows, count(rating) AS parsed FROM t GROUP BY status)
SELECT n.status, CAST(g.rating AS INT) AS rating, n.rows, n.parsed,
  round(CASE WHEN n.parsed=0 THEN 0.0 ELSE (SELECT count(*) FROM t WHERE t.status=n.status AND t.rating=g.rating)::DOUBLE/n.parsed END,6) AS p
FROM n CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS rating) g""")
def rating_parse(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("text"))
    texts = texts.unionByName(table(spark, sf, "conversations").select(F.col("role").alias("status"), "text"))
    parsed = texts.select("status", fx.rating_from_text("text").alias("rating"))
    pmf = reports.rating_pmf(parsed, by=["status"]).withColumn("p", r6("p"))
    return pmf.join(reports.parse_report(parsed, by=["status"]), "status")


@query("""SELECT p_partkey AS unit_id, replace(replace(replace(replace(replace(replace(lower(p_brand||' and Kids'' Toys, '||p_type||' & Pre-K'),' and ','_and_'),'&','and'),',',''),'''',''),'-','_'),' ','_') AS name FROM part""")
def name_normalize(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat("p_brand", F.lit(" and Kids' Toys, "), "p_type", F.lit(" & Pre-K"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), fx.normalized(label).alias("name"))


@query("""SELECT md5(CAST(c_custkey AS VARCHAR)||chr(1)||c_name||chr(1)||CAST(c_nationkey AS VARCHAR)) AS row_id, c_custkey AS unit_id, c_acctbal AS c_balance, c_mktsegment, c_name FROM customer""")
def column_select(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "customer").withColumn("row_id", row_key("c_custkey", "c_name", "c_nationkey"))
    keyed = cx.without_columns(keyed, names=["c_nationkey"])
    renamed = keyed.withColumnRenamed("c_custkey", "unit_id").withColumnRenamed("c_acctbal", "c_balance")
    return renamed.select("row_id", "unit_id", *cx.columns_with_prefix(renamed, ["c_"]))


@query(f"WITH {UNITS_SQL} SELECT unit_id, category, CAST(s AS DOUBLE) AS label FROM units WHERE s=1 UNION ALL SELECT unit_id, category, 0.0::DOUBLE FROM units WHERE s=0")
def treated_untreated(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    sides = [f(u).select("unit_id", "category", fx.flag_label("s").alias("label")) for f in (cx.treated, cx.untreated)]
    return cx.concat_by_name(*sides)


@query(f"""SELECT event_id AS unit_id, CASE WHEN u<0.1 THEN 'propensity' WHEN u<0.4 THEN 'half_a' WHEN u<0.7 THEN 'half_b' ELSE 'test' END AS split
FROM (SELECT event_id, {u_sql('event_id', 'split')} AS u FROM events)""")
def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_split(table(spark, sf, "events").select(F.col("event_id").alias("unit_id")))


@query(f"""SELECT split, count(*) AS rows, round(count(*)::DOUBLE/(SELECT count(*) FROM events),6) AS share FROM (
SELECT CASE WHEN u<0.1 THEN 'propensity' WHEN u<0.4 THEN 'half_a' WHEN u<0.7 THEN 'half_b' ELSE 'test' END AS split
FROM (SELECT event_id, {u_sql('event_id', 'split')} AS u FROM events)) GROUP BY split""")
def split_report(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_report(split_assign(spark, sf)).withColumn("share", r6("share"))


def _order_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("side"))


def _ranked_sql(purpose: str) -> str:
    u = u_sql("o_orderkey", purpose)
    return f"SELECT o_orderkey AS unit_id, o_orderstatus AS side, {u} AS u, row_number() OVER (ORDER BY {u}, o_orderkey) AS rn FROM orders"


_RANKED = _ranked_sql("order")


@query(f"""SELECT unit_id, CASE WHEN u<0.5 THEN 0 ELSE 1 END AS fold, CASE WHEN rn<=(SELECT count(*)//2 FROM orders) THEN 0 ELSE 1 END AS half FROM ({_ranked_sql('fold')})""")
def cross_fold(spark: SparkSession, sf: str) -> DataFrame:
    ids = _order_ids(spark, sf).select("unit_id")
    return splits.random_fold(splits.exact_halves(ids, out="half"))


@query(f"SELECT unit_id, rn FROM ({_RANKED})")
def shuffled_order(spark: SparkSession, sf: str) -> DataFrame:
    return splits.shuffled_rank(_order_ids(spark, sf).select("unit_id"))


@query(f"SELECT unit_id, CAST(least((rn-1)//(SELECT count(*)//4 FROM orders),3) AS INT) AS chunk FROM ({_RANKED})")
def chunk_assign(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_chunk(_order_ids(spark, sf).select("unit_id"), 4)


@query(f"SELECT unit_id, side FROM ({_RANKED}) WHERE rn<=2000")
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample_n(_order_ids(spark, sf), 2000)


@query(f"""SELECT unit_id, side FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY u, unit_id) AS r FROM ({_RANKED}))
WHERE r<=(SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))""")
def equal_size(spark: SparkSession, sf: str) -> DataFrame:
    return splits.equal_size(_order_ids(spark, sf), "side")


@query(f"""WITH {UNITS_SQL} SELECT count(*) AS total, count(*) FILTER (s=1) AS n_treated, round(count(*) FILTER (s=1)*100.0/count(*),6) AS pct_treated,
count(*) FILTER (rating=1) AS n_urgent, round(count(*) FILTER (rating=1)*100.0/count(*),6) AS pct_urgent FROM units""")
def count_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.count_summary(units(spark, sf), {"treated": F.col("s") == 1, "urgent": F.col("rating") == 1})
    return out.withColumns({"pct_treated": r6("pct_treated"), "pct_urgent": r6("pct_urgent")})


@query(f"WITH {UNITS_SQL} " + " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", round(avg({c}),4) AS mean, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(stddev_samp({c}),4) AS std FROM units'
    for c in ("x1", "x2", "rating")))
def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.column_summary(units(spark, sf), ["x1", "x2", "rating"])
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(f"WITH {UNITS_SQL} SELECT rating, count(*) AS rows, round(count(*)*100.0/(SELECT count(*) FROM units),6) AS pct FROM units GROUP BY rating")
def value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_distribution(units(spark, sf), "rating").withColumn("pct", r6("pct"))


@query(f"""WITH {UNITS_SQL}, grid AS (SELECT DISTINCT category FROM units)
SELECT g.category, CAST(t.rating AS INT) AS rating, round(coalesce(n,0)::DOUBLE/sum(coalesce(n,0)) OVER (PARTITION BY g.category),6) AS p
FROM grid g CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS rating) t LEFT JOIN (SELECT category, rating, count(*) AS n FROM units WHERE s=1 GROUP BY 1,2) c
ON c.category=g.category AND c.rating=t.rating""")
def rating_pmf(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rating_pmf(cx.treated(units(spark, sf)), by=["category"]).withColumn("p", r6("p"))


@query("""SELECT o_orderkey AS unit_id, round(q,9) AS p, round(1.0/(1.0+exp(8.5-2.0*ln(q/(1.0-q)))),9) AS p_shifted
FROM (SELECT o_orderkey, least(greatest(o_totalprice/500000.0,0.001),0.999) AS q FROM orders)""")
def logit_shift(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice") / 500000.0
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("unit_id"), r6(nx.clipped(p, nx.CLIP_LOW, nx.CLIP_HIGH), 9).alias("p"),
        r6(nx.shifted_probability(p), 9).alias("p_shifted"),
    )


_COVARIATES = ("x1", "x2", "rating", "b")


@query(f"WITH {UNITS_SQL} SELECT covariate, round(o,4) AS overall_mean, round(t,4) AS treated_mean, round(c,4) AS control_mean, round(t-c,4) AS difference FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS covariate, avg({c}) AS o, avg({c}) FILTER (s=1) AS t, avg({c}) FILTER (s=0) AS c FROM units" for c in _COVARIATES) + ")")
def balance_table(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.balance_table(units(spark, sf), _COVARIATES)
    return out.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in out.columns if c != "covariate"})


@query("SELECT o_orderkey AS unit_id, abs(o_totalprice-250000) AS score FROM orders ORDER BY abs(o_totalprice-250000) DESC, o_orderkey LIMIT 10")
def top_by_size(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.abs(F.col("o_totalprice") - 250000).alias("score"))
    return reports.top_n(ids, F.col("score"), 10, "unit_id")


@query("SELECT doc_id AS unit_id, lang AS category FROM documents ORDER BY lang, doc_id LIMIT 5")
def preview_ordered(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("category"))
    return reports.ordered_preview(docs, 5, "category", "unit_id")


@query("""SELECT c_custkey AS unit_id, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("unit_id"))
    return cx.concat_by_name(a, b)


@query(f"""WITH {DOCS_SQL} SELECT unit_id, category, s, w_right FROM docs WHERE s=1 UNION ALL SELECT unit_id, category, s, NULL FROM docs WHERE s=0""")
def union_fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    docs = weighted_documents(spark, sf)
    return cx.concat_by_name(
        cx.treated(docs).select("unit_id", "category", "s", "w_right"), cx.untreated(docs).select("unit_id", "category", "s"),
        fill_missing=True,
    )


@query("""SELECT event_id AS unit_id FROM events WHERE event_type='click' UNION ALL SELECT event_id FROM events WHERE value>50""")
def union_positional(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    clicks = events.filter(F.col("event_type") == "click").select(F.col("event_id").alias("unit_id"))
    return clicks.union(events.filter(F.col("value") > 50).select("event_id"))


@query("SELECT DISTINCT c_mktsegment AS category, c_nationkey FROM customer")
def distinct_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"), "c_nationkey").distinct()


@query("""SELECT o_orderkey AS unit_id, o_totalprice AS x1, n_lines FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey=l_orderkey""")
def attach_by_key(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("x1"))
    return lookup.attach_by_key(orders, lines, "unit_id")
