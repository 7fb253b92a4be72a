"""Mixing by iterative proportional fitting: token weights raked to marginals, documents sampled by calibrated chances.

The tokens of every cell (source x language x topic) are summed up once. Sweeps over the dimensions then scale the cells
so that each marginal meets its target, for a corpus of ``rate`` times the tokens; no cell may ask for more tokens than it
has, so a cell is capped at its own tokens after every sweep and the others take up the rest. A document is kept with the
chance of its cell, drawn from a hash of its key. DataFrame functions only.

Targets are given per dimension as ``{value: share}`` or as a temperature ``t``: shares in proportion to the tokens'
share to the power ``t`` (1 leaves the marginal as it is, 0 makes it even).

Defined results: null dimension values are a value of their own; a value without a given share keeps its observed one
before normalising; texts without tokens weigh nothing and get the chance of their cell; a cell without any tokens keeps
its documents; a null key draws like the empty text; an empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterpoise.functions.hashing import keyed_uniform
from counterpoise.session import stage

# Fixed value: the words of a text are the runs outside this white space.
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: str | Column) -> Column:
    """A coarse topic from the form of a whole text, for tables that carry none."""
    text = F.col(text) if isinstance(text, str) else text
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty").when(F.instr(text, " | ") > 0, "table")
        .when(F.lower(text).rlike("licen[cs]e|copyright|rights reserved"), "notice")
        .when(F.instr(text, "@") > 0, "contact").when(F.instr(text, "?") > 0, "question").otherwise("prose")
    )


def _shares(cells: DataFrame, targets: dict[str, float | dict[str, float]]) -> DataFrame:
    """Adds the wanted tokens of each dimension value; only the total and one sum per dimension reach the driver."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    for name, target in targets.items():
        own = Window.partitionBy(name)
        share = F.sum("tokens").over(own) / F.lit(max(total, 1.0))
        if isinstance(target, dict):
            wanted = F.lit(None).cast("double")
            for value, given in target.items():
                wanted = F.when(F.col(name) == value, F.lit(float(given))).otherwise(wanted)
            share = F.coalesce(wanted, share)
        else:
            share = F.when(share > 0, F.pow(share, F.lit(float(target)))).otherwise(0.0)
        cells = cells.withColumn(f"target_{name}", share).withColumn(f"cells_{name}", F.count("*").over(own))
    cells = stage(cells, "mix-targets")
    norms = cells.agg(*[F.coalesce(F.sum(F.col(f"target_{n}") / F.col(f"cells_{n}")), F.lit(1.0)) for n in targets]).first()
    for name, norm in zip(targets, norms):
        cells = cells.withColumn(f"target_{name}", F.col(f"target_{name}") / F.lit(norm or 1.0) * F.lit(total))
    return cells


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], rate: float = 0.7, sweeps: int = 8) -> DataFrame:
    """``chance`` of every cell. ``cells`` has the dimensions and ``tokens``, one row per combination that occurs."""
    cells = _shares(cells, targets).withColumn("weight", F.col("tokens") * F.lit(float(rate)))
    for _ in range(sweeps):
        for name in targets:
            margin = F.sum("weight").over(Window.partitionBy(name))
            factor = F.when(margin > 0, F.col(f"target_{name}") * F.lit(float(rate)) / margin).otherwise(1.0)
            cells = cells.withColumn("weight", F.col("weight") * factor)
        cells = cells.withColumn("weight", F.least(F.col("weight"), F.col("tokens").cast("double")))
    chance = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    return cells.select(*targets, "tokens", "weight", F.least(chance, F.lit(1.0)).alias("chance"))


def mix(
    docs: DataFrame, targets: dict[str, float | dict[str, float]], dimensions: dict[str, Column], key: str = "doc_id", text: str = "text",
    rate: float = 0.7, sweeps: int = 8, seed: int = 42,
) -> DataFrame:
    """Every document with ``mix_tokens``, ``mix_chance`` and ``mix_kept`` beside its own columns.

    ``dimensions`` maps each name of ``targets`` to the column expression of its value. The cells come from one pass over
    the documents; their chances are joined back, by broadcast while their table is small and by shuffle beyond.
    """
    named = [dimensions[name].alias(f"__mix_{name}") for name in targets]
    cells = docs.select(*named, token_count(text).alias("tokens")).groupBy(*[f"__mix_{n}" for n in targets]).agg(F.sum("tokens").alias("tokens"))
    cells = cells.select(*[F.coalesce(F.col(f"__mix_{n}").cast("string"), F.lit("\u0000")).alias(n) for n in targets], "tokens")
    chances = stage(rake(stage(cells, "mix-cells"), targets, rate, sweeps), "mix-chances")
    chances = chances.select(*[F.col(n).alias(f"__cell_{n}") for n in targets], F.col("chance").alias("mix_chance"))
    on = [F.coalesce(dimensions[n].cast("string"), F.lit("\u0000")) == F.col(f"__cell_{n}") for n in targets]
    out = docs.withColumn("mix_tokens", token_count(text)).join(chances, on, "left").drop(*[f"__cell_{n}" for n in targets])
    draw = keyed_uniform(F.coalesce(F.col(key).cast("string"), F.lit("")), "mix", seed)
    return out.withColumn("mix_kept", draw < F.col("mix_chance"))
