"""Integrity audit and cascading erasure over the six tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from findmill import schemas


def _violation(df: DataFrame, table: str, rule: str, column: str, key: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column_name"),
        F.col(key).cast("string").alias("key_value"),
    )


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose parent is missing.  Distinct keys are compared first, so a parent
    with very many children costs one key."""
    found = []
    for child, key, parent in schemas.FOREIGN_KEYS:
        keys = tables[child].select(key).filter(F.col(key).isNotNull()).distinct()
        parents = tables[parent].select(F.col("id").alias(key))
        lost = keys.join(parents, key, "left_anti")
        rows = tables[child].join(lost, key, "left_semi")
        found.append(_violation(rows, child, "orphan", key, "id"))
    return reduce(DataFrame.unionAll, found)


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Values occurring more than once in a unique column."""
    found = []
    for table, column in schemas.UNIQUE_KEYS:
        repeated = (
            tables[table].groupBy(column).agg(F.count("*").alias("n"))
            .filter((F.col("n") > 1) & F.col(column).isNotNull())
        )
        found.append(_violation(repeated, table, "duplicate", column, column))
    return reduce(DataFrame.unionAll, found)


def overlong_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows with a text above its column's limit: one scan per table."""
    found = []
    for table in dict.fromkeys(t for t, _, _ in schemas.TEXT_LIMITS):
        faults = F.array_compact(
            F.array(
                *[
                    F.when(F.char_length(c) > limit, F.lit(c))
                    for t, c, limit in schemas.TEXT_LIMITS
                    if t == table and c in tables[table].columns
                ]
            )
        )
        rows = tables[table].select("id", F.explode(faults).alias("column_name"))
        found.append(
            rows.select(
                F.lit(table).alias("table_name"), F.lit("too_long").alias("rule"), "column_name",
                F.col("id").cast("string").alias("key_value"),
            )
        )
    return reduce(DataFrame.unionAll, found)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All findings of the audit: (table_name, rule, column_name, key_value)."""
    return orphans(tables).unionAll(duplicate_keys(tables)).unionAll(overlong_texts(tables))


def erase(
    tables: dict[str, DataFrame], table: str, ids: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Survivors of every table when the rows ``ids`` (id) of ``table`` go, with all their
    descendants; and the archive paths of the repositories that went.

    ``write_survivors`` puts the survivors in a new place: Parquet is not changed in place.
    """
    doomed = {table: ids.select("id").distinct()}
    for child, key, parent in schemas.FOREIGN_KEYS:
        if parent not in doomed or child in doomed:
            continue
        gone = doomed[parent].select(F.col("id").alias(key))
        doomed[child] = tables[child].join(gone, key, "left_semi").select("id")
    survivors = dict(tables)
    foreign = {child: (key, parent) for child, key, parent in schemas.FOREIGN_KEYS}
    for name in doomed:
        key, parent = foreign.get(name, (None, None))
        if name == table or parent not in doomed:
            survivors[name] = tables[name].join(doomed[name], "id", "left_anti")
        else:
            gone = doomed[parent].select(F.col("id").alias(key))
            survivors[name] = tables[name].join(gone, key, "left_anti")
    repositories = tables["repositories"]
    if "repositories" in doomed:
        paths = repositories.join(doomed["repositories"], "id", "left_semi").select("zip_path")
    else:
        paths = repositories.select("zip_path").limit(0)
    return survivors, paths


def write_survivors(survivors: dict[str, DataFrame], base: str) -> None:
    """Write the tables that an erasure leaves to a new place."""
    for name, df in survivors.items():
        df.write.parquet(f"{base}/{name}")
