"""Erasure in stored tables that rewrites only the files it touches.

The tables' files are listed in numbered snapshots, themselves a Parquet table (number, table_name,
file) beside them.  An erasure finds the files that hold doomed rows by ``_metadata.file_path``, writes
what survives of those files anew, and lists the new files with all the untouched ones as the next
snapshot.  Writing that list is the last step: whoever reads meanwhile, or after a failure, sees the
snapshot before, whole.  Replaced files stay until ``unlisted_files`` are removed.

Only file names come to the driver, as they do in any scan of these tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from findmill import schemas
from findmill.sources.tables import read_table

_SNAPSHOTS = "_snapshots"
_LIST = "number BIGINT, table_name STRING, file STRING"


def _files(df: DataFrame) -> list[str]:
    """Files that hold rows of ``df``, as paths to read them by."""
    held = {r.file for r in df.select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    return sorted(held)


def _listed(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(_LIST).parquet(f"{base}/{_SNAPSHOTS}")


def _commit(spark: SparkSession, base: str, number: int, files: dict[str, list[str]]) -> None:
    rows = [(number, name, file) for name, found in files.items() for file in found]
    # a snapshot without any file still has its number
    rows = rows or [(number, None, None)]
    spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("append").parquet(f"{base}/{_SNAPSHOTS}")


def track(spark: SparkSession, base: str) -> None:
    """Start with snapshot 0: all files of the tables below ``base``."""
    _commit(spark, base, 0, {name: _files(read_table(spark, base, name)) for name in schemas.TABLES})


def latest(spark: SparkSession, base: str) -> int:
    return _listed(spark, base).agg(F.max("number")).first()[0]


def files_at(spark: SparkSession, base: str, number: int | None = None) -> dict[str, list[str]]:
    """Files of each table in a snapshot (the latest)."""
    number = latest(spark, base) if number is None else number
    files: dict[str, list[str]] = {name: [] for name in schemas.TABLES}
    for r in _listed(spark, base).where((F.col("number") == number) & F.col("file").isNotNull()).collect():
        files[r.table_name].append(r.file)
    return files


def _read(spark: SparkSession, name: str, files: list[str]) -> DataFrame:
    schema = schemas.TABLES[name]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def tables_at(spark: SparkSession, base: str, number: int | None = None) -> dict[str, DataFrame]:
    """The six tables as they are in a snapshot (the latest)."""
    return {name: _read(spark, name, files) for name, files in files_at(spark, base, number).items()}


def erase_stored(spark: SparkSession, base: str, table: str, ids: DataFrame) -> int:
    """Erase the rows ``ids`` (id) of ``table`` with all their descendants; the number of the new snapshot.

    Ids that do not occur erase nothing; rows with a NULL id or parent stay.
    """
    before = latest(spark, base)
    files = files_at(spark, base, before)
    # by table: the column that dooms a row, and its values
    doomed = {table: ("id", ids.select("id").distinct())}
    for child, key, parent in schemas.FOREIGN_KEYS:
        if parent not in doomed or child in doomed:
            continue
        column, values = doomed[parent]
        parents = _read(spark, parent, files[parent])
        gone = parents.join(values, column, "left_semi").select(F.col("id").alias(key)).distinct()
        doomed[child] = (key, gone)
    after = dict(files)
    for name, (column, values) in doomed.items():
        if not files[name]:
            continue
        rows = _read(spark, name, files[name]).select(column, F.col("_metadata.file_path").alias("file"))
        touched = {r.file for r in rows.join(values, column, "left_semi").select("file").distinct().collect()}
        if not touched:
            continue
        path = f"{base}/_rewritten/{name}-{before + 1}-{uuid.uuid4().hex}"
        _read(spark, name, sorted(touched)).join(values, column, "left_anti").select(*schemas.TABLES[name].names).write.parquet(path)
        after[name] = [f for f in files[name] if f not in touched] + _files(spark.read.schema(schemas.TABLES[name]).parquet(path))
    _commit(spark, base, before + 1, after)
    return before + 1


def unlisted_files(spark: SparkSession, base: str) -> list[str]:
    """Files of earlier snapshots that the latest one does not list any more: they hold what was erased."""
    number = latest(spark, base)
    listed = _listed(spark, base).where("file IS NOT NULL")
    now = listed.where(F.col("number") == number).select("file")
    return sorted(r.file for r in listed.select("file").distinct().join(now, "file", "left_anti").collect())
