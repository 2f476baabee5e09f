"""Erasure that rewrites only the files it touches."""

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from findmill import schemas
from findmill.operators import erasure, integrity
from findmill.sources import sinks
from findmill.sources.tables import read_tables


def store(spark, base, users=20):
    """Every user has one repository, report, analysis result and prediction, and 30 findings; by user in files."""
    ids = spark.range(1, users + 1)
    keyed = {
        "users": ids, "repositories": ids.withColumn("user_id", F.col("id")), "reports": ids.withColumn("repository_id", F.col("id")),
        "analysis_results": ids.withColumn("report_id", F.col("id")), "ml_predictions": ids.withColumn("report_id", F.col("id")),
        "findings": spark.range(0, users * 30).withColumn("report_id", F.floor(F.col("id") / 30) + 1),
    }
    for name, df in keyed.items():
        absent = {f.name: F.lit(None).cast(f.dataType) for f in schemas.TABLES[name] if f.name not in df.columns}
        sinks.append(df.withColumns(absent).repartitionByRange(10, "id"), base, name)
    # a finding without a report belongs to nobody
    lost = spark.createDataFrame([(10_000, None)], "id long, report_id long")
    sinks.append(lost.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.TABLES["findings"][2:]}), base, "findings")
    erasure.track(spark, base)


def changed(file):
    return os.stat(urlparse(file).path).st_mtime_ns


def rows_of(tables):
    return {name: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


def test_only_touched_files_are_rewritten(spark, tmp_path):
    base = str(tmp_path / "stored")
    store(spark, base)
    first = erasure.files_at(spark, base)
    assert len(first["findings"]) == 11
    stamps = {f: changed(f) for found in first.values() for f in found}
    ids = spark.createDataFrame([(7,)], "id long")
    want = rows_of(integrity.erase(read_tables(spark, base), "users", ids)[0])

    assert erasure.erase_stored(spark, base, "users", ids) == 1
    assert rows_of(erasure.tables_at(spark, base)) == want
    second = erasure.files_at(spark, base)
    for name in schemas.TABLES:
        gone = set(first[name]) - set(second[name])
        # the findings of a user are neighbours, in two files at most
        assert 1 <= len(gone) <= (2 if name == "findings" else 1)
        assert gone <= set(erasure.unlisted_files(spark, base))
    assert {f: changed(f) for f in stamps} == stamps
    # the snapshot before is still whole
    assert rows_of(erasure.tables_at(spark, base, 0)) == rows_of(read_tables(spark, base))


def test_nothing_repeated_and_everything(spark, tmp_path):
    base = str(tmp_path / "stored")
    store(spark, base, users=4)
    nothing = spark.createDataFrame([(99,), (None,)], "id long")
    assert erasure.erase_stored(spark, base, "users", nothing) == 1
    assert erasure.files_at(spark, base, 0) == erasure.files_at(spark, base, 1)
    erasure.erase_stored(spark, base, "reports", spark.createDataFrame([(2,), (2,)], "id long"))
    assert {n: df.count() for n, df in erasure.tables_at(spark, base).items()} == {
        "users": 4, "repositories": 4, "reports": 3, "analysis_results": 3, "findings": 91, "ml_predictions": 3,
    }
    erasure.erase_stored(spark, base, "users", spark.range(1, 5))
    assert {n: df.count() for n, df in erasure.tables_at(spark, base).items()} == {n: int(n == "findings") for n in schemas.TABLES}
    erasure.erase_stored(spark, base, "findings", spark.createDataFrame([(10_000,)], "id long"))
    assert erasure.latest(spark, base) == 4 and not any(erasure.files_at(spark, base).values())
    assert erasure.erase_stored(spark, base, "users", spark.range(3)) == 5
