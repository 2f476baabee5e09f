"""Documents made of ordered parts, at every size.

A document is the concatenation of its parts in the order of ``place``.  Parts are
cut at ranges of the finding key, so a part has a bounded number of rows without
ranking anything, and a report with very many findings never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAGE = 1000

PLACE = "struct<section:int,major:bigint,minor:bigint,page:bigint,name:string>"


def place(section: int, major=0, minor=0, page=0, name="") -> Column:
    """Position of a part inside its document."""
    values = [section, major, minor, page, name]
    columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.struct(*columns).cast(PLACE)


def in_order(documents: DataFrame) -> DataFrame:
    """Reading order; a range-partitioned sort, also across one large document."""
    return documents.orderBy("report_id", "place")


def write_texts(documents: DataFrame, path: str) -> None:
    """Write documents in reading order as (report_id, place, text) Parquet."""
    in_order(documents).write.parquet(path)
