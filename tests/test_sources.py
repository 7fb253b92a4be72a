import json

import pytest
from pyspark.sql import functions as F

from counterpoise.plans import storage
from counterpoise.plans.reviews import review_features
from counterpoise.sources import readers, writers


def test_key_dictionary_is_read_in_pieces(spark, tmp_path, monkeypatch):
    entries = {f"B{i:05d}": ["Arts, Crafts & Sewing", 'a "quoted", "pair"', "plain", "back\\slash"][i % 4] for i in range(5_000)}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(entries))
    slices, real = [], readers.stage
    monkeypatch.setattr(readers, "stage", lambda df, name: slices.append(df.count()) or real(df, name) if name == "dictionary-slices" else real(df, name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = readers.read_key_dictionary(spark, str(path))
        # As many slices as the file has room for, each counted on its own.
        assert slices == [-(-path.stat().st_size // 20_000)] and slices[0] > 4
        assert {r["key"]: r["category"] for r in frame.collect()} == entries
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in readers.dictionary_values(frame).collect()] == sorted(set(entries.values()))


@pytest.mark.parametrize("form", [{"separators": (",", ":")}, {"separators": (", ", ": ")}, {"indent": 2}, {"indent": 0}])
def test_key_dictionary_keeps_every_entry(spark, tmp_path, form):
    hard = ['ends in ", ', 'a","b', '", "', "back\\", "{ }", '{"x": 1}', " blanks ", "\t", ",", "é☃", ""]
    entries = {f"{i} {x}": hard[(i * 7) % len(hard)] for i, x in enumerate(hard * 3)}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(entries, **form))
    assert {r["key"]: r["category"] for r in readers.read_key_dictionary(spark, str(path)).collect()} == entries


def test_key_dictionary_entries_cross_slices(spark, tmp_path):
    """Slices of 500 bytes: values over several slices, quotes and commas at their edges, several files of several forms."""
    long = ['x, "y" ' * 300, '\\",\\', '",' * 400, "\\" * 999 + '"', "", "plain, "]
    forms = [{"separators": (",", ":")}, {"indent": 1}, {}]
    want = {}
    for f, form in enumerate(forms):
        entries = {f"{f}-{i}": long[(i * 5 + f) % len(long)] for i in range(60)}
        want |= entries
        (tmp_path / f"d{f}.json").write_text(json.dumps(entries, **form))
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "none.json").write_text("{ }\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_key_dictionary(spark, str(tmp_path / "*.json")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 180 and {r["key"]: r["category"] for r in rows} == want


@pytest.mark.parametrize(
    "text",
    ['{"a": "b", "c": 1 2}', '{"a": "b"', '{"a": "b"} {"c": "d"}', '{"a": "b",, "c": "d"}', '{"a": {"b": "c", "d": "e"}}', '{"a": "b",}', '"a": "b"', '{"a": "b, "c": "d"}', "{"],
)
def test_key_dictionary_names_what_it_cannot_read(spark, tmp_path, text):
    path = tmp_path / "d.json"
    path.write_text(text)
    with pytest.raises(ValueError, match="d.json"):
        readers.read_key_dictionary(spark, str(path)).collect()


def test_rows_without_a_metric_are_written(spark, tmp_path):
    df = spark.range(3).withColumn("text", F.lit("x"))
    writers.write_with_metric(df, df.where("id < 2").select("id", F.lit(1.0).alias("m")), "id", str(tmp_path / "o"))
    assert sorted((r["id"], r["m"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(0, 1.0), (1, 1.0), (2, None)]


def test_typed_scan_turns_bad_fields_into_null(spark, tmp_path):
    good = {"rating": 5.0, "title": "t", "text": "x", "images": [{"a": "b"}], "parent_asin": "p", "user_id": "u", "timestamp": 1, "verified_purchase": True}
    bad = dict(good, rating="many", timestamp="soon")
    (tmp_path / "Toys.jsonl").write_text("\n".join(map(json.dumps, (good, bad))))
    (tmp_path / "Video_Games.jsonl").write_text(json.dumps(good))
    df = readers.read_json_by_file(spark, str(tmp_path / "*.jsonl"), readers.REVIEW_SCHEMA)
    rows = df.orderBy("file_category", F.col("rating").desc()).collect()
    assert [r["file_category"] for r in rows] == ["Toys", "Toys", "Video_Games"]
    assert rows[1]["rating"] is None and rows[1]["title"] == "t" and json.loads(rows[0]["images"][0]) == {"a": "b"}


def test_missing_columns_are_named(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError, match="text"):
        readers.read_parquet(spark, str(tmp_path / "a"), ["id", "text"])


def test_write_if_missing_and_files(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert writers.write_if_missing(df.drop("x"), path, ["id"])
    assert writers.write_if_missing(df, path, ["x"])
    assert not writers.write_if_missing(df, path, ["x"])
    writers.write_parquet(df, path, files=3)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3 and spark.read.parquet(path).count() == 100


def test_half_written_and_damaged_folders_are_written_again(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "out"), spark.range(100).withColumn("x", F.col("id") * 2)
    df.write.parquet(path)  # no manifest: it may be half a table
    assert writers.read_manifest(spark, path) is None and writers.write_if_missing(df, path, ["x"])
    assert writers.read_manifest(spark, path) == {"rows": 100, "columns": {"id": "bigint", "x": "bigint"}}
    assert not writers.write_if_missing(df, path, ["x"])
    df.limit(3).write.mode("append").parquet(path)
    assert not writers.is_complete(spark, path) and writers.write_if_missing(df, path, ["x"])
    (tmp_path / "out" / writers.MANIFEST).write_text("{")
    (tmp_path / "out" / f".{writers.MANIFEST}.crc").unlink(missing_ok=True)
    assert writers.write_if_missing(df, path, ["x"]) and spark.read.parquet(path).count() == 100
    # Rows that fail before anything is removed leave the old table whole.
    with pytest.raises(Exception):
        writers.write_committed(df.withColumn("x", F.raise_error(F.lit("stop")).cast("long")), path)
    assert writers.is_complete(spark, path) and spark.read.parquet(path).count() == 100

    def interrupted(df, path, **_):
        df.limit(7).write.mode("overwrite").parquet(path)
        raise RuntimeError

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(writers, "write_parquet", interrupted)
        writers.write_committed(df, path)
    assert not writers.is_complete(spark, path) and writers.write_if_missing(df, path, ["x"])
    empty = str(tmp_path / "empty")
    assert writers.write_if_missing(df.limit(0), empty, ["x"]) and not writers.write_if_missing(df, empty, ["x"])


def test_scopes_leave_only_the_result(spark):
    from counterpoise import session

    paths = []

    def build():
        inner = session.stage(spark.range(10), "inner")
        nested = session.settled(spark, lambda: session.stage(inner.where("id > 4"), "deep"), "nested")
        paths.extend([*inner.inputFiles(), *nested.inputFiles()])
        return nested.withColumn("x", F.lit(1))

    exists = lambda p: writers._file_system(spark, p)[0].exists(writers._file_system(spark, p)[1])
    out = session.settled(spark, build, "result")
    assert out.count() == 5 and paths and not any(exists(p) for p in paths)
    with pytest.raises(RuntimeError), session.stage_scope(spark):
        paths.extend(session.stage(spark.range(3), "lost").inputFiles())
        raise RuntimeError
    assert not exists(paths[-1]) and out.count() == 5
    kept = session.stage(spark.range(2), "kept")
    assert all(exists(p) for p in kept.inputFiles())


def test_generated_samples_document(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"weight_column": "naive", "num_samples": 2, "samples": ["5 stars: a", "b"]}, indent=1))
    rows = readers.read_generated_samples(spark, str(tmp_path / "*.json")).collect()
    assert [tuple(r) for r in rows] == [("naive", 0, "5 stars: a"), ("naive", 1, "b")]


def test_review_features_from_raw_rows(spark):
    reviews = spark.createDataFrame(
        [(1, "p1", True, 5.0, "t", "x"), (2, "p2", None, 1.0, "t", "y"), (3, "p9", False, 2.0, "t", "z")],
        "unit_id long, parent_asin string, verified_purchase boolean, rating float, title string, text string",
    )
    products = spark.createDataFrame(
        [("p1", "Name", ["a", "b"], [{"u": "1"}], None, {"k": "v"}), ("p1", None, None, None, [], None)],
        "parent_asin string, title string, description array<string>, images array<map<string,string>>, videos array<map<string,string>>, details map<string,string>",
    )
    dictionary = spark.createDataFrame([("p1", "Toys & Games"), ("p2", "Books")], "key string, category string")
    out = review_features(reviews, products, dictionary).orderBy("unit_id", "title_length").collect()
    assert [r["unit_id"] for r in out] == [1, 1, 2]
    assert (out[1]["title_length"], out[1]["description_length"], out[1]["image_count"], out[1]["details_length"]) == (4, 3, 1, 3)
    assert out[2]["title_length"] == 0 and out[2]["category_books"] == 1 and out[2]["category_toys_and_games"] == 0


def test_written_documents_stay_small(spark, tmp_path, monkeypatch):
    """A large table becomes more documents, not larger ones."""
    monkeypatch.setattr(storage, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(storage, "_ENTRIES", 1_000)
    monkeypatch.setattr(storage, "_SAMPLES", 100)
    orders = spark.range(10_000).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("some text").alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert storage.key_dictionary(spark, str(tmp_path)).distinct().count() == 10_000
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "dictionary").glob("part=*/*.txt")]
    assert sum(sizes) == 10_000 and len(sizes) >= 10 and max(sizes) < 1_500
    assert storage.samples_indented(spark, str(tmp_path)).first()["samples"] == 2_000
    sizes = [len(json.loads(p.read_text())["samples"]) for p in (tmp_path / "samples-indented").glob("name=*/part=*/*.txt")]
    assert sum(sizes) == 2_000 and len(sizes) >= 20 and max(sizes) < 200
