"""Semi-synthetic treatments with known propensity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.features import MISSING_RATING, MISSING_TEXT, hide_when_untreated
from counterpoise.functions.hashing import keyed_uniform


def draw_treatment(df: DataFrame, p: str, unit_id: str = "unit_id", seed: int = 42, out: str = "s_synthetic") -> DataFrame:
    """``Bernoulli(p)`` from the row key, so a re-run or a lost task draws the same value."""
    return df.withColumn(out, F.when(keyed_uniform(unit_id, "treatment", seed) < F.col(p), 1).otherwise(0))


def semi_synthetic(
    df: DataFrame, p: str, truly_treated: str = "s", unit_id: str = "unit_id", seed: int = 42,
    text_columns: tuple[str, ...] = ("text",), rating: str = "rating", keep_outcomes: bool = False,
) -> DataFrame:
    """Truly treated rows with a synthetic treatment; outcomes hidden where it is 0.

    ``keep_outcomes`` is for the test split. One narrow pass.
    """
    drawn = draw_treatment(df.filter(F.col(truly_treated) == 1), p, unit_id, seed)
    if keep_outcomes:
        return drawn
    hidden = {c: hide_when_untreated("s_synthetic", c, MISSING_TEXT) for c in text_columns}
    hidden[rating] = hide_when_untreated("s_synthetic", rating, MISSING_RATING)
    return drawn.withColumns(hidden)
