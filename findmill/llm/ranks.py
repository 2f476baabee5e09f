"""Positions of rows in their group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from findmill.llm.tables import durable


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, rank: str = "rank", size: str = "size") -> DataFrame:
    """``df`` with each row's position by ``order`` in its ``group``, from 0, and the group's rows.

    Rows are cut at ranges of (group, order), so a hot group spreads over many tasks; rows are numbered
    inside their range, and the few (group, range) counts are added up.  Group columns are never NULL.
    Only rows equal in all of ``group`` and ``order`` stay in one range; give columns that tell them apart
    or leave only rows alike.
    """
    by = [F.asc_nulls_first(c) for c in (*group, *order)]
    cut = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    # written once, so a recomputed task can't number its rows in another way
    cut = durable(cut, name).withColumn("__range", F.shiftright("__at", 33))
    counts = cut.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group, "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"),
        F.sum("__n").over(whole).alias(size),
    )
    return (
        cut.join(starts, [*group, "__range"])
        .withColumn(rank, F.col("__start") + F.col("__at"))
        .drop("__at", "__range", "__start")
    )
