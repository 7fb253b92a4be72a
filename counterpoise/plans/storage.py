"""Queries that go through the sources and sinks: write, read back, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.operators import reports, splits
from counterpoise.plans.fixtures import table, u_sql
from counterpoise.plans.registry import query, rounded
from counterpoise.session import scratch_path
from counterpoise.sources import readers, writers


@query("SELECT event_id, user_id, event_type, value, json_extract_string(props,'$.k') AS k FROM events")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "events-json")
    events = table(spark, sf, "events").withColumn("props", F.from_json("props", "map<string,string>"))
    events.write.json(path)
    schema = "event_id bigint, user_id bigint, event_type string, value double, props map<string,string>"
    back = readers.read_json_lines(spark, path, schema)
    return back.select("event_id", "user_id", "event_type", "value", F.col("props")["k"].alias("k"))


@query("SELECT c_mktsegment AS file_category, c_custkey, c_acctbal FROM customer")
def json_by_file(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "segment-json")
    # One file per segment, as the raw data comes; each segment is a folder whose name the reader takes.
    table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal").withColumn(
        "seg", F.col("c_mktsegment")
    ).write.partitionBy("seg").json(root)
    back = readers.read_json_by_file(spark, f"{root}/seg=*", "c_custkey bigint, c_acctbal double", folder_pattern="seg=([^/]+)/")
    return back.select("file_category", "c_custkey", "c_acctbal")


# Rows of a written document, on average; their number follows the table.
_ENTRIES, _SAMPLES = 20_000, 2_000


def _parts(df: DataFrame, key: str, rows: int) -> Column:
    """A hash part of the key, so many that each holds about ``rows`` rows."""
    return F.pmod(F.xxhash64(key), F.lit(df.count() // rows + 1))


_HARD = "o_orderpriority||CASE o_orderkey%4 WHEN 0 THEN ', ' WHEN 1 THEN '\", ' WHEN 2 THEN ' ' ELSE '' END||'\"'||o_orderstatus||'\"'"


def _write_dictionary(spark: SparkSession, sf: str, separator: str, hard: bool) -> str:
    """Files of one JSON object each; with ``hard`` the values end in what looks like a separator."""
    path = scratch_path(spark, "dictionary")
    ends = F.when(F.col("o_orderkey") % 4 == 0, ", ").when(F.col("o_orderkey") % 4 == 1, '", ').when(F.col("o_orderkey") % 4 == 2, " ").otherwise("")
    value = F.concat("o_orderpriority", ends if hard else F.lit(', "'), F.lit('"') if hard else F.lit(""), "o_orderstatus", F.lit('"'))
    entry = F.regexp_replace(F.to_json(F.create_map(F.col("o_orderkey").cast("string"), value)), r"^\{|\}$", "")
    part = _parts(table(spark, sf, "orders"), "o_orderkey", _ENTRIES)
    rows = table(spark, sf, "orders").select(part.alias("part"), entry.alias("entry"))
    # Every file holds one object of about _ENTRIES entries, at any size of the table.
    body = rows.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("entry")), separator), F.lit("}")).alias("value"))
    body.write.partitionBy("part").text(path)
    return path


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority||', \"'||o_orderstatus||'\"' AS category FROM orders")
def key_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_key_dictionary(spark, _write_dictionary(spark, sf, ", ", False))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, {_HARD} AS category FROM orders")
def key_dictionary_hard(spark: SparkSession, sf: str) -> DataFrame:
    """Compact objects whose values end in quotes and commas."""
    return readers.read_key_dictionary(spark, _write_dictionary(spark, sf, ",", True))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, {_HARD} AS category FROM orders")
def key_dictionary_lines(spark: SparkSession, sf: str) -> DataFrame:
    """An entry per line."""
    return readers.read_key_dictionary(spark, _write_dictionary(spark, sf, ",\n  ", True))


@query("""SELECT lang AS weight_column, position, count(*) AS samples, sum(length(sample))::BIGINT AS characters FROM
(SELECT lang, CAST(unnest(range(0,len(s))) AS INT) AS position, unnest(s) AS sample FROM (SELECT lang, string_split(text,chr(10)) AS s FROM documents)) GROUP BY lang, position""")
def samples_document(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "samples")
    docs = table(spark, sf, "documents").select(F.col("lang").alias("weight_column"), F.split("text", "\n").alias("samples"))
    docs.write.json(path)
    back = readers.read_generated_samples(spark, path, one_per_line=True)
    return back.groupBy("weight_column", "position").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.length("text")).alias("characters"))


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice*2,6) AS doubled FROM orders")
def write_if_missing(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "doubled")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    writers.write_parquet(orders, path, files=4)
    second = orders.withColumn("doubled", rounded(F.col("o_totalprice") * 2))
    target = scratch_path(spark, "doubled")
    first_time = writers.write_if_missing(second, target, ["doubled"])
    again = writers.write_if_missing(second.limit(0), target, ["doubled"])
    if not first_time or again:
        raise RuntimeError("the write-once sink wrote twice or not at all")
    return readers.read_parquet(spark, target, ["o_orderkey", "o_totalprice", "doubled"])


@query(f"""SELECT split, count(*) AS rows, round(sum(value),4) AS total FROM (SELECT value, CASE WHEN u<0.1 THEN 'propensity' WHEN u<0.4 THEN 'half_a' WHEN u<0.7 THEN 'half_b' ELSE 'test' END AS split
FROM (SELECT value, {u_sql('event_id', 'split')} AS u FROM events)) GROUP BY split""")
def splits_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path, copy = scratch_path(spark, "splits"), scratch_path(spark, "split-copy")
    events = table(spark, sf, "events").select(F.col("event_id").alias("unit_id"), "value")
    writers.write_parquet(splits.assign_split(events), path, partition_by=["split"])
    writers.copy_table(spark, f"{path}/split=test", copy)
    names = {n: f"{path}/split={n}" for n in ("propensity", "half_a", "half_b")} | {"test": copy}
    back = readers.read_splits(spark, names)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), rounded(F.sum("value"), 4).alias("total"))


@query("""SELECT count(*) AS total, count(*) FILTER (event_type='purchase') AS n_purchase, round(count(*) FILTER (event_type='purchase')*100.0/count(*),6) AS pct_purchase FROM events""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    summary = reports.count_summary(table(spark, sf, "events"), {"purchase": F.col("event_type") == "purchase"})
    writers.write_summary(summary, path)
    back = spark.read.schema("total bigint, n_purchase bigint, pct_purchase double").json(path)
    return back.withColumn("pct_purchase", rounded("pct_purchase"))


@query("SELECT doc_id, lang, CAST(n_chars*2 AS BIGINT) AS metric FROM documents")
def metric_detail(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "detail")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    metric = table(spark, sf, "documents").select("doc_id", (F.length("text") * 2).cast("bigint").alias("metric"))
    writers.write_with_metric(docs, metric, "doc_id", path)
    return readers.read_parquet(spark, path)


@query("SELECT lang AS weight_column, count(*) AS samples, sum(length(text))::BIGINT AS characters FROM documents GROUP BY lang")
def samples_indented(spark: SparkSession, sf: str) -> DataFrame:
    """One indented document per file."""
    path = scratch_path(spark, "samples-indented")
    docs = table(spark, sf, "documents")
    # A document holds about _SAMPLES samples of one language, as bounded as the generated files.
    docs = docs.groupBy(F.col("lang").alias("weight_column"), _parts(docs, "doc_id", _SAMPLES).alias("part")).agg(F.collect_list("text").alias("samples"))
    body = F.to_json(F.struct("weight_column", "samples"), {"pretty": "true"})
    docs.select(F.col("weight_column").alias("name"), "part", body.alias("value")).write.partitionBy("name", "part").text(path)
    back = readers.read_generated_samples(spark, f"{path}/name=*/part=*")
    return back.groupBy("weight_column").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.length("text")).alias("characters"))
