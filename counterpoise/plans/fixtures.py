"""Canonical views over the given tables, as DataFrames and as the matching SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.hashing import keyed_uniform
from counterpoise.operators.ipw import inverse_propensity_by_stratum, stabilized_many
from counterpoise.operators.splits import random_fold
from counterpoise.session import stage

# Fixed cut points of the price strata.
CUTS = (100_000, 250_000)
IPW = {"right": "ipw_right", "wrong": "ipw_wrong"}
FEATURES = ["x1", "x2"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer as units: treated when fulfilled, outcome is the priority 1..5."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    rating = F.substring("o_orderpriority", 1, 1).cast("int")
    base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("unit_id"), F.col("c_mktsegment").alias("category"),
        F.col("o_totalprice").alias("x1"), F.col("c_acctbal").alias("x2"), rating.alias("rating"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("s"),
        F.when(rating <= 2, 1).otherwise(-1).alias("b"),
        F.when(F.col("o_totalprice") < CUTS[0], 0).when(F.col("o_totalprice") < CUTS[1], 1).otherwise(2).alias("cut"),
    )
    return random_fold(base)


def propensity_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units with the stratified inverse propensity of the right and the wrong specification."""
    # Several passes of aggregates follow: the join and the hashes are done once.
    base = stage(units(spark, sf), "units")
    right = inverse_propensity_by_stratum(base, ["category", "cut"], out="f_right")
    return inverse_propensity_by_stratum(right, ["cut"], out="f_wrong")


def weighted_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units with both stabilised weights."""
    return stabilized_many(propensity_units(spark, sf), {"ipw_right": "f_right", "ipw_wrong": "f_wrong"})


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with nullable labels."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def weighted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as units with a nullable treatment and a positive row weight from the key."""
    return labelled_documents(spark, sf).select(
        F.col("doc_id").alias("unit_id"), F.col("lang").alias("category"), "text", F.col("quality").alias("s"),
        (F.lit(0.5) + keyed_uniform("doc_id", "weight", 7)).alias("w_right"),
        F.when(F.col("toxic") == 0, F.lit(1.0) + keyed_uniform("doc_id", "weight", 8)).alias("w_wrong"),
    )


def u_sql(key: str, purpose: str, seed: int = 42) -> str:
    return f"(('0x'||substr(md5('{purpose}|{seed}|'||CAST({key} AS VARCHAR)),1,13))::BIGINT/4503599627370496.0)"


UNITS_SQL = f"""units AS (
  SELECT o_orderkey AS unit_id, c_mktsegment AS category, o_totalprice AS x1, c_acctbal AS x2,
    CAST(substr(o_orderpriority,1,1) AS INT) AS rating, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS s,
    CASE WHEN CAST(substr(o_orderpriority,1,1) AS INT)<=2 THEN 1 ELSE -1 END AS b,
    CASE WHEN o_totalprice<{CUTS[0]} THEN 0 WHEN o_totalprice<{CUTS[1]} THEN 1 ELSE 2 END AS cut,
    CASE WHEN {u_sql('o_orderkey', 'fold')}<0.5 THEN 0 ELSE 1 END AS fold
  FROM orders JOIN customer ON o_custkey=c_custkey)"""

PROPENSITY_SQL = UNITS_SQL + """,
cell_right AS (SELECT category, cut, 1-fold AS fold, count(*)::DOUBLE/nullif(sum(s),0) AS f FROM units GROUP BY 1,2,3),
cell_wrong AS (SELECT cut, 1-fold AS fold, count(*)::DOUBLE/nullif(sum(s),0) AS f FROM units GROUP BY 1,2),
propensity AS (SELECT u.*, r.f AS f_right, w.f AS f_wrong FROM units u
  LEFT JOIN cell_right r ON r.category=u.category AND r.cut=u.cut AND r.fold=u.fold
  LEFT JOIN cell_wrong w ON w.cut=u.cut AND w.fold=u.fold)"""

WEIGHTED_SQL = PROPENSITY_SQL + """,
clipped AS (SELECT *, CASE WHEN s=1 THEN greatest(coalesce(f_right,1),1) END AS r0, CASE WHEN s=1 THEN greatest(coalesce(f_wrong,1),1) END AS w0,
  (count(*) OVER (PARTITION BY fold))::DOUBLE/(sum(s) OVER (PARTITION BY fold)) AS target FROM propensity),
capped AS (SELECT *, CASE WHEN s=1 THEN least(r0*target/avg(r0) OVER (PARTITION BY fold),1000) END AS r1, CASE WHEN s=1 THEN least(w0*target/avg(w0) OVER (PARTITION BY fold),1000) END AS w1 FROM clipped),
weighted AS (SELECT unit_id, category, x1, x2, rating, s, b, cut, fold, f_right, f_wrong,
  coalesce(r1*target/avg(r1) OVER (PARTITION BY fold),0) AS ipw_right, coalesce(w1*target/avg(w1) OVER (PARTITION BY fold),0) AS ipw_wrong FROM capped)"""

DOCS_SQL = f"""docs AS (
  SELECT d.doc_id AS unit_id, lang AS category, text, quality AS s, 0.5+{u_sql('d.doc_id', 'weight', 7)} AS w_right,
    CASE WHEN toxic=0 THEN 1.0+{u_sql('d.doc_id', 'weight', 8)} END AS w_wrong
  FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)"""


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[ \\t\\n\\r\\f]+'), lambda w: w<>'')"


def sides_sql(block: str = "category||'|'", where: str = "s=1", scaled: bool = True) -> str:
    """Queries and candidates of the cross-fitted pairing, standardised per side."""
    cols = "unit_id, x1, x2, rating, s, b, ipw_right, ipw_wrong"
    if not scaled:
        return f""",
zq AS (SELECT {cols}, {block}||(1-fold) AS blk FROM weighted), zc AS (SELECT {cols}, {block}||fold AS blk FROM weighted WHERE {where})"""
    z = "(a.x1-t.m1)/t.d1 AS z1, (a.x2-t.m2)/t.d2 AS z2"
    stat = (
        "SELECT blk, avg(x1) AS m1, CASE WHEN stddev_samp(x1)>0 THEN stddev_samp(x1) ELSE 1 END AS d1, "
        "avg(x2) AS m2, CASE WHEN stddev_samp(x2)>0 THEN stddev_samp(x2) ELSE 1 END AS d2"
    )
    return f""",
q AS (SELECT {cols}, {block}||(1-fold) AS blk FROM weighted), c AS (SELECT {cols}, {block}||fold AS blk FROM weighted WHERE {where}),
zq AS (SELECT a.*, {z} FROM q a JOIN ({stat} FROM q GROUP BY blk) t ON a.blk=t.blk),
zc AS (SELECT a.*, {z} FROM c a JOIN ({stat} FROM c GROUP BY blk) t ON a.blk=t.blk)"""


def edges_sql(k: int, name: str = "edges", columns: tuple[str, ...] = ("z1", "z2"), queries: str = "zq", candidates: str = "zc") -> str:
    dist = "+".join(f"(a.{c}-m.{c})*(a.{c}-m.{c})" for c in columns)
    return f""",
{name} AS (SELECT * FROM (SELECT a.blk, a.unit_id AS query_id, m.unit_id AS match_id, {dist} AS dist, a.ipw_right, a.ipw_wrong,
  row_number() OVER (PARTITION BY a.blk, a.unit_id ORDER BY {dist}, m.unit_id) AS rnk FROM {queries} a JOIN {candidates} m ON a.blk=m.blk) WHERE rnk<={k})"""
