"""Scans: typed JSON lines, key dictionaries, Parquet tables, generated-sample documents."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.session import stage

_BLANKS = " \t\r\n"
# Fixed schemas of the raw review and product files.
REVIEW_SCHEMA = (
    "rating float, title string, text string, images array<string>, asin string, parent_asin string, "
    "user_id string, timestamp bigint, verified_purchase boolean"
)
PRODUCT_SCHEMA = (
    "main_category string, title string, description array<string>, images array<map<string,string>>, "
    "videos array<map<string,string>>, details map<string,string>, parent_asin string"
)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines under a declared schema; a malformed field becomes null, not an error."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_json_by_file(
    spark: SparkSession, path: str, schema: T.StructType | str, name_column: str = "file_category",
    name_pattern: str = r"^(?:meta_)?(.*?)\.jsonl?(?:\..+)?$", folder_pattern: str | None = None,
) -> DataFrame:
    """One scan over a whole directory or glob; the category comes from each file's name, or from its folder's."""
    df = spark.read.schema(schema).json(path)
    # Only file metadata is read, so column pruning on the data still applies.
    name = F.regexp_extract(F.col("_metadata.file_path"), folder_pattern, 1) if folder_pattern else F.regexp_extract(F.col("_metadata.file_name"), name_pattern, 1)
    return df.withColumn(name_column, name)


def read_key_dictionary(spark: SparkSession, path: str, key: str = "key", value: str = "category") -> DataFrame:
    """A single JSON object ``{"k": "v", ...}`` per file as rows (key, value); compact, spaced or with an entry per line.

    The object may be gigabytes on one line, so the text is cut at every comma and Spark reads its slices in parallel. A comma
    parts two entries if an even number of quotes, escaped ones aside, stands before it in the file: each slice counts its
    quotes and its commas for both possible starts, prefix sums over the slices of a file say which start is true, and the
    pieces of an entry are put together by its number. A task holds one slice, or the pieces of one entry. Blank files and
    empty objects have no rows. What is no object of strings raises a ``ValueError``: no entry is lost without a word.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.translate(bare, '"', ""))
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    # Ids grow with the place in a slice, starts of slices with the place in a file.
    read = spark.read.option("lineSep", ",").text(path).select("value", file, block, F.monotonically_increasing_id().alias("at"), quotes.alias("quotes"))
    so_far = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    pieces = read.withColumn("odd", F.sum("quotes").over(so_far) % 2)
    for start, name in ((0, "if_even"), (1, "if_odd")):
        pieces = pieces.withColumn(name, F.coalesce(F.count(F.when(F.col("odd") == start, 1)).over(before), F.lit(0)))
    pieces = stage(pieces, "dictionary-pieces")

    cuts = lambda start: F.count(F.when(F.col("odd") == start, 1))
    slices = pieces.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("parity"), cuts(0).alias("even"), cuts(1).alias("odd"), F.max(F.trim("value", F.lit(_BLANKS)) != "").alias("text"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("starts_odd", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2 == 1)
    slices = slices.withColumn("cuts", F.when(F.col("starts_odd"), F.col("odd")).otherwise(F.col("even")))
    whole = W.partitionBy("file")
    # The last piece of a closed object counts as cut, so cuts are entries; an open string at the end leaves one entry more.
    slices = stage(
        slices.select(
            "file", "block", "starts_odd", F.coalesce(F.sum("cuts").over(earlier), F.lit(0)).alias("first"),
            F.sum("cuts").over(whole).alias("entries"), F.max("text").over(whole).alias("text"),
        ).filter("text").drop("text"), "dictionary-slices",
    )
    number = F.col("first") + F.when(F.col("starts_odd"), F.col("if_odd")).otherwise(F.col("if_even"))
    numbered = pieces.join(slices, ["file", "block"]).select("file", "entries", number.alias("number"), F.struct("block", "at", "value").alias("piece"), "quotes")
    entries = numbered.groupBy("file", "entries", "number").agg(
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["value"]), ","), F.lit(_BLANKS)).alias("body"),
        F.sum("quotes").alias("quotes"),
    )
    is_first, is_last = F.col("number") == 0, F.col("number") == F.col("entries") - 1
    opened = ~is_first | F.startswith("body", F.lit("{"))
    closed = (~is_last | F.endswith("body", F.lit("}"))) & (F.col("number") < F.col("entries"))
    # Only the object's own braces go; blanks at the ends of a string are part of it.
    start, cut = F.when(is_first, 2).otherwise(1), is_first.cast("int") + is_last.cast("int")
    inner = F.trim(F.substring("body", start, F.length("body") - cut), F.lit(_BLANKS))
    empty = (F.col("entries") == 1) & (inner == "")
    # An entry has four quotes that are not escaped; more of them would be text that the parser leaves out.
    m = F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), "map<string,string>")
    parsed = entries.select((opened & closed).alias("ends"), empty.alias("empty"), "quotes", m.alias("m"))
    parsed = stage(parsed, "key-dictionary")
    if not parsed.where("NOT ends OR NOT empty AND (m IS NULL OR size(m) <> 1 OR quotes <> 4)").isEmpty():
        raise ValueError(f"{path} holds something else than one JSON object of strings per file")
    return parsed.where("NOT empty").select(F.explode("m").alias(key, value))


def dictionary_values(dictionary: DataFrame, value: str = "category") -> DataFrame:
    """Distinct values in order."""
    return dictionary.select(value).distinct().orderBy(value)


def read_parquet(spark: SparkSession, paths: str | Iterable[str], required: Iterable[str] = ()) -> DataFrame:
    """Parquet scan of one or many directories; names every missing required column."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing} in {', '.join(paths)}")
    return df


def read_splits(spark: SparkSession, splits: Mapping[str, str], name_column: str = "split") -> DataFrame:
    """Named splits concatenated by column name, with the split each row came from."""
    frames = [spark.read.parquet(path).withColumn(name_column, F.lit(name)) for name, path in splits.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_generated_samples(spark: SparkSession, path: str | list[str], one_per_line: bool = False) -> DataFrame:
    """JSON documents, each with an array of samples: one row per sample with its position.

    A file is one (possibly indented) document, or with ``one_per_line`` a
    splittable file of one document per line.
    """
    docs = spark.read.schema("weight_column string, samples array<string>").option("multiLine", not one_per_line).json(path)
    return docs.select("weight_column", F.posexplode("samples").alias("position", "text"))
