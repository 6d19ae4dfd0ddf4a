"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``lookup`` (at most one row per key) onto ``rows``.

    Rows of one key are spread over ``salts`` join keys by a hash of the
    ``spread`` columns and the lookup is repeated once per salt, so a key with a
    third of all rows is no single task's work. There is no broadcast hint: where
    the lookup turns out small, adaptive execution broadcasts it by its measured
    size.
    """
    if not spread:  # rows are unique by key, no key can be hot
        return rows.join(lookup, list(keys), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    repeated = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
