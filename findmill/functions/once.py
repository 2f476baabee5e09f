"""Columns that are worked out once, however often they are used later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and ``columns``.

    The optimizer repeats an expression in every later filter and column that uses it; it
    does not look through the explode of an array of one.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(values)).alias("__once")).select(*keep, "__once.*")
