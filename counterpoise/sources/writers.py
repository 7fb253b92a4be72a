"""Sinks: Parquet with size control, write-once outputs, saved models, summaries."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(
    df: DataFrame, path: str, *, partition_by: Iterable[str] = (), files: int | None = None,
    max_rows_per_file: int = 5_000_000, codec: str = "snappy",
) -> None:
    """Overwrite a Parquet directory.

    With ``files`` the rows are spread evenly over that many files; without
    it AQE picks the number from the data size (a rebalance also splits a
    skewed partition value over several tasks).
    """
    partition_by = list(partition_by)
    out = df.repartition(files) if files else df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = out.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def has_columns(spark: SparkSession, path: str, required: Iterable[str]) -> bool:
    """True when a readable Parquet table with all those columns is already at ``path``."""
    try:
        return set(required) <= set(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


# Files whose names start with an underscore are no data to Spark.
MANIFEST = "_manifest.json"


def write_committed(df: DataFrame, path: str, **options) -> None:
    """``write_parquet``, and then a manifest of the rows and columns that are there.

    Overwriting removes the old manifest with the old files, before the first new one, so a folder left half-written by a lost
    driver has none; rows that fail earlier leave the old table as it was. The manifest takes its name in one step.
    """
    spark = df.sparkSession
    write_parquet(df, path, **options)
    written = spark.read.parquet(path)
    text = json.dumps({"rows": written.count(), "columns": [[f.name, f.dataType.simpleString()] for f in written.schema]})
    fs, target = _file_system(spark, f"{path}/{MANIFEST}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_{MANIFEST}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, target):
        raise OSError(f"cannot name the manifest of {path}")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """Rows and columns that a finished write left, or None."""
    fs, target = _file_system(spark, f"{path}/{MANIFEST}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        found = json.loads(text)
        return {"rows": int(found["rows"]), "columns": {name: kind for name, kind in found["columns"]}}
    except (ValueError, KeyError, TypeError):
        return None


def is_complete(spark: SparkSession, path: str, required: Iterable[str] = ()) -> bool:
    """True when a finished write with all those columns is at ``path`` and every row of it still is; reads footers only."""
    manifest = read_manifest(spark, path)
    if manifest is None or not set(required) <= set(manifest["columns"]) or not has_columns(spark, path, required):
        return False
    return spark.read.parquet(path).count() == manifest["rows"]


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_if_missing(df: DataFrame, path: str, required: Iterable[str]) -> bool:
    """Write only when no finished table with the required columns is there; returns whether it wrote."""
    if is_complete(df.sparkSession, path, required):
        return False
    write_committed(df, path)
    return True


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """Copy one split unchanged, keeping a dataset's layout complete."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file; the rows are already aggregated."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_with_metric(df: DataFrame, metric: DataFrame, key: str, path: str) -> None:
    """Source columns with a per-row metric next to them, matched by key; rows without a metric stay, with null."""
    write_parquet(df.join(metric, key, "left"), path)
