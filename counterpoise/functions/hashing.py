"""Uniform numbers that depend on a row's key only, never on file layout or task order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, which a double holds exactly.
_DIGITS = 13


def keyed_uniform(key: str | Column, purpose: str, seed: int = 42) -> Column:
    """Uniform on [0, 1) from ``md5(purpose|seed|key)``; repeatable in any SQL engine with md5.

    The purpose keeps a row's draws independent of each other: with one hash
    for all, a sample or a treatment would follow the split it is taken in.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", F.lit(purpose), F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def salt(key: str | Column, n: int | Column) -> Column:
    """Salt number in [0, n) from the row key, stable across retries."""
    key = F.col(key) if isinstance(key, str) else key
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(key), n.cast("long")).cast("int")


def row_key(*columns: str) -> Column:
    """Surrogate id from the row's content, for tables that carry no key of their own."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
