import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, or from (doc_id, text); extra columns carry names that operators use inside."""

    def build(texts, extra=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(k, t, ["en", "fr", None][(k or 0) % 3], f"s{(k or 0) % 2}", len(t or "")) for k, t in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            for name in ("k", "node", "component", "size", "score", "row", "n", "weight", "chance", "part"):
                df = df.withColumn(name, F.lit(name))
        return df

    return build


LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ODD = [None, "", " ", "\n\n", "a", "x" * 70_000, LONG, "one two three four five six seven", "one two three four five six seven", "😀 漢字 \u0000 é"]


@pytest.fixture(scope="session")
def odd():
    return ODD
