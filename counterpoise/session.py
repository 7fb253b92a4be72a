"""Session settings and the shared scratch folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Spark's switch for removing the shuffle files of an SQL execution as soon as it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Paths handed out inside each open scope, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "counterpoise") -> SparkSession:
    """A session for tests and single-node runs; cluster jobs bring their own."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` when the cluster names one.

    Executors on other machines must see it, so a machine-local folder is
    only ever chosen for a ``local`` master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="counterpoise-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's scratch folder; no two calls share one."""
    path = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    return path


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/counterpoise/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    _delete(spark, _application_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside once the block ends, by an error too.

    What a DataFrame of the block still has to read must be written before; ``settled`` does so for a result. Scopes nest:
    a table belongs to the innermost one. Work that the block starts in other threads is not covered.
    """
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            _delete(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of ``build`` as a written table, without the intermediate tables it was made of."""
    path = scratch_path(spark, name)
    with stage_scope(spark):
        df = build()
        _write(df, path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts lineage durably (a lost executor re-reads the files) and gives
    the planner the true size of the result, so small results are broadcast by
    Spark's own size check and large ones are shuffled. The shuffle files of
    the write go with it instead of waiting for the driver's garbage collection.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLE_CLEANUP, None)
    conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_SHUFFLE_CLEANUP)
        else:
            conf.set(_SHUFFLE_CLEANUP, before)

