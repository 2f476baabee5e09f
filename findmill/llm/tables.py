"""Shared helpers: intermediate tables, ASCII text rules, grouped streams of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findmill.session import durable

__all__ = [
    "SPACES", "ascii_lower", "durable", "forget", "grouped_runs", "packed", "release_memory", "settled", "strip_spaces", "table", "unpacked", "unused",
]

#: The white space that the text rules name: space and the controls 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def strip_spaces(text: Column) -> Column:
    """Without SPACES at both ends."""
    return F.btrim(text, F.lit(SPACES))


def packed(docs: DataFrame, **needed: Column) -> DataFrame:
    """All columns of ``docs`` in the struct ``row`` beside the ``needed`` ones, so that no name clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in needed.items()])


def unpacked(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The packed columns again, with ``added`` ones, which replace columns of the same name."""
    return df.select(
        *[F.col("row").getField(c).alias(c) for c in columns if c not in added], *[c.alias(n) for n, c in added.items()]
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def settled(df: DataFrame, name: str) -> DataFrame:
    """``durable``, with the shuffle files of the write removed as soon as the table is there.

    Else they stay until the driver happens to collect its garbage, beside those of the steps that follow.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return durable(df, name)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote, once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: idle workers stay for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def grouped_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with all rows of each key of a stream sorted by ``keys``.

    Groups are expected to be of bounded size; a group may span several batches.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        values = list(zip(*columns))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield from work(pa.Table.from_batches(held))
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield from work(pa.Table.from_batches(held))
