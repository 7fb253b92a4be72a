"""The attribute-table study: -1/+1 columns, one of them the intervention, to nine weight columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.numeric import trait_distorted
from counterpoise.operators import columns as cx
from counterpoise.operators import ipw, reports, resample, splits, weights
from counterpoise.plans.fixtures import edges_sql, table, u_sql
from counterpoise.plans.registry import query, rounded
from counterpoise.session import stage

NINE_WEIGHTS = [
    "no_wgt", "ipw_right", "ipw_wrong", "gcomp_right", "gcomp_wrong", "aipw_rightProp_rightOut", "aipw_wrongProp_rightOut",
    "aipw_rightProp_wrongOut", "aipw_wrongProp_wrongOut",
]
# The only weight column kept on the test split.
TEST_WEIGHT = "aipw_rightProp_rightOut"


def attribute_weights(
    df: DataFrame, intervention: str, trait: str, *, post: Sequence[str] = (), strata: Sequence[str], k: int = 200,
    unit_id: str = "unit_id", probes: int | None = 10, seed: int = 42, test_split: bool = False, **knn,
) -> DataFrame:
    """All nine weights of every row; with ``test_split`` only the doubly robust one.

    Post-treatment columns leave first. The inverse propensity minimises the
    squared-error criterion inside each stratum of the other half; its wrong
    version shrinks the weight of rows without the trait. Neighbours use all
    remaining -1/+1 attributes.
    """
    base = cx.without_columns(df, post)
    attributes = [c for c in cx.plus_minus_one_columns(base) if c != intervention]
    base = base.withColumn("s", ((F.col(intervention) + 1) / 2).cast("int"))
    base = splits.exact_halves(ipw.naive(base, out="no_wgt"), unit_id, seed)
    fitted = ipw.inverse_propensity_by_stratum(base, strata)
    right = ipw.self_normalized(fitted, "f", out="ipw_right")
    both = ipw.self_normalized(right, "f", out="ipw_wrong", factor=trait_distorted(F.lit(1.0), trait))
    both = stage(both.drop("f"), "attribute-ipw")
    out = weights.subgroup_weights(
        both, k, attributes, trait, {"right": "ipw_right", "wrong": "ipw_wrong"}, unit_id=unit_id, probes=probes, **knn
    )
    kept = [TEST_WEIGHT] if test_split else NINE_WEIGHTS
    return out.select(unit_id, *kept, intervention, *attributes)


def attribute_balance(df: DataFrame, intervention: str, exclude: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The covariates that differ most between the two groups, on the 0/1 scale."""
    base = cx.without_columns(df, exclude, ["ipw_", "aipw_", "gcomp_"])
    binary = cx.plus_minus_one_columns(base)
    coded = cx.recode_plus_minus_one(base, binary)
    return reports.balance_table(coded, [c for c in binary if c != intervention], intervention).limit(n)


def resampled_counterfactuals(weighted: DataFrame, n: int = 10_000, unit_id: str = "unit_id", seed: int = 42) -> DataFrame:
    """n rows drawn in proportion to the doubly robust weight."""
    return resample.weighted_resample(weighted, TEST_WEIGHT, n, unit_id, seed)


def _attributes(spark: SparkSession, sf: str) -> DataFrame:
    pm = lambda condition: F.when(condition, 1).otherwise(-1)
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("unit_id"), pm(F.col("o_orderstatus") == "F").alias("fulfilled"), pm(rank <= 2).alias("urgent"),
        pm(F.col("o_totalprice") > 250_000).alias("large"), pm(F.col("c_acctbal") > 5_000).alias("wealthy"),
        pm(F.col("c_mktsegment") == "MACHINERY").alias("machinery"), pm(rank == 5).alias("late"),
    )


_ATTRIBUTES = """a AS (SELECT o_orderkey AS unit_id, CASE WHEN o_orderstatus='F' THEN 1 ELSE -1 END AS fulfilled, CASE WHEN substr(o_orderpriority,1,1)<='2' THEN 1 ELSE -1 END AS urgent,
  CASE WHEN o_totalprice>250000 THEN 1 ELSE -1 END AS large, CASE WHEN c_acctbal>5000 THEN 1 ELSE -1 END AS wealthy, CASE WHEN c_mktsegment='MACHINERY' THEN 1 ELSE -1 END AS machinery,
  CASE WHEN substr(o_orderpriority,1,1)='5' THEN 1 ELSE -1 END AS late FROM orders JOIN customer ON o_custkey=c_custkey)"""


@query(f"WITH {_ATTRIBUTES} SELECT covariate, round(o,6) AS overall_mean, round(t,6) AS treated_mean, round(c,6) AS control_mean, round(t-c,6) AS difference FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS covariate, avg(({c}+1)/2) AS o, avg(({c}+1)/2) FILTER (fulfilled=1) AS t, avg(({c}+1)/2) FILTER (fulfilled=-1) AS c FROM a" for c in ("urgent", "large", "wealthy", "machinery")) + ")")
def attribute_balance_table(spark: SparkSession, sf: str) -> DataFrame:
    out = attribute_balance(_attributes(spark, sf), "fulfilled", ["late"])
    return out.withColumns({c: rounded(c) for c in out.columns if c != "covariate"})


def _nine_sql(k: int) -> str:
    both = ("urgent", "large", "wealthy", "machinery")
    ctes, joins, picks = "", "", []
    for spec, where, cols in (("right", "s=1", both), ("wrong", "s=1 AND urgent=1", both[1:])):
        ctes += f""",
q_{spec} AS (SELECT *, 1-fold AS blk FROM w), c_{spec} AS (SELECT *, fold AS blk FROM w WHERE {where}){edges_sql(k, f'edges_{spec}', cols, f'q_{spec}', f'c_{spec}')},
near_{spec} AS (SELECT match_id, count(*)/{float(k)} AS g, sum(1-ipw_right)/{k} AS ar, sum(1-ipw_wrong)/{k} AS aw FROM edges_{spec} GROUP BY match_id)"""
        joins += f" LEFT JOIN near_{spec} ON near_{spec}.match_id=w.unit_id"
        picks.append(f"round(coalesce(near_{spec}.g,0),6) AS gcomp_{spec}")
        picks += [f"round(ipw_{p}+coalesce(near_{spec}.a{p[0]},0),6) AS aipw_{p}Prop_{spec}Out" for p in ("right", "wrong")]
    return f"""WITH {_ATTRIBUTES}, r AS (SELECT *, CASE WHEN fulfilled=1 THEN 1 ELSE 0 END AS s,
  CASE WHEN row_number() OVER (ORDER BY {u_sql('unit_id', 'fold')}, unit_id)<=(SELECT count(*)//2 FROM a) THEN 0 ELSE 1 END AS fold FROM a),
g AS (SELECT large, urgent, 1-fold AS fold, count(*)::DOUBLE/nullif(sum(s),0) AS f FROM r GROUP BY 1,2,3),
v AS (SELECT r.*, CASE WHEN s=1 THEN greatest(coalesce(f,1),1) ELSE 0 END AS v1 FROM r LEFT JOIN g ON r.large=g.large AND r.urgent=g.urgent AND r.fold=g.fold),
w AS (SELECT *, s/(SELECT avg(s) FROM r) AS no_wgt, v1/avg(v1) OVER (PARTITION BY fold) AS ipw_right,
  v1*(1-0.75*(1-urgent)/2.0)/avg(v1*(1-0.75*(1-urgent)/2.0)) OVER (PARTITION BY fold) AS ipw_wrong FROM v){ctes}
SELECT unit_id, round(no_wgt,6) AS no_wgt, round(ipw_right,6) AS ipw_right, round(ipw_wrong,6) AS ipw_wrong, {', '.join(picks)} FROM w{joins}"""


@query(_nine_sql(200))
def attribute_nine_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = attribute_weights(_attributes(spark, sf), "fulfilled", "urgent", post=["late"], strata=["large", "urgent"], k=200, probes=None)
    return out.select("unit_id", *[rounded(c).alias(c) for c in NINE_WEIGHTS])


@query()
def attribute_resample(spark: SparkSession, sf: str) -> DataFrame:
    weighted = attribute_weights(
        _attributes(spark, sf), "fulfilled", "urgent", post=["late"], strata=["large", "urgent"], test_split=True
    )
    return resample.draw_histogram(resampled_counterfactuals(stage(weighted, "attribute-weights")))
