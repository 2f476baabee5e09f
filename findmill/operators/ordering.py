"""Orders, top-N and unions of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from findmill import vocab
from findmill.functions import labels

# digits of the largest BIGINT
_DIGITS = 19


def number_in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``ord``, increasing with ``columns``.

    A range-partitioned sort: the columns go beyond the report, so one large report
    spreads over many partitions.  Numbers have gaps; only their order counts.
    """
    return df.orderBy(*columns).withColumn("ord", F.monotonically_increasing_id())


def order_text(*numbers: Column) -> Column:
    """Text that sorts like the tuple of these non-negative whole numbers, whatever their size."""
    return F.concat_ws(".", *[F.lpad(n.cast("string"), _DIGITS, "0") for n in numbers])


def order_of(findings: DataFrame) -> Column:
    """The column ``ord`` as text that sorts like it; it may be a number or such a text already."""
    is_text = isinstance(findings.schema["ord"].dataType, T.StringType)
    return F.col("ord") if is_text else order_text(F.col("ord"))


def union_findings(*sources: DataFrame) -> DataFrame:
    """Bag union.  ``ord`` becomes unique: all of the first source, then all of the second, ..."""
    shifted = [
        df.withColumn("ord", F.concat_ws(".", order_text(F.lit(i)), order_of(df)))
        for i, df in enumerate(sources)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shifted)


def seq_of(static: Column, order: Column) -> Column:
    """``seq`` of a finding by its order among findings that are static or not."""
    return F.concat_ws(".", F.when(static, "1").otherwise("0"), order)


def input_order(findings: DataFrame) -> DataFrame:
    """Add ``seq``, a text that sorts findings that are not static first, then static ones,
    each by ``ord``."""
    return findings.withColumn("seq", seq_of(F.col("source") == vocab.STATIC, order_of(findings)))


def by_severity(findings: DataFrame, *ties: str) -> DataFrame:
    """Most severe first, then most confident, then ``ties``; within each report."""
    return findings.orderBy(
        "report_id",
        labels.severity_rank(F.col("severity")).desc_nulls_last(),
        F.col("confidence").desc(),
        *ties,
    )


def top_findings(findings: DataFrame, n: int = vocab.TOP_FINDINGS, tie: str = "ord") -> DataFrame:
    """First ``n`` findings of each report in severity order, with their ``rank``.

    Spark limits each group before the shuffle, so a large report sends few rows.
    """
    order = Window.partitionBy("report_id").orderBy(
        labels.severity_rank(F.col("severity")).desc_nulls_last(), F.col("confidence").desc(), tie
    )
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
