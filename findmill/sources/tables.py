"""The six relational tables, as Parquet with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findmill import schemas


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{base}/{name}")


def read_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, base, name) for name in schemas.TABLES}


def text_list(json_text) -> "F.Column":
    """JSON text of a list, [] for anything else."""
    return F.coalesce(F.from_json(json_text, "array<string>"), F.array().cast("array<string>"))


def number_map(json_text) -> "F.Column":
    """JSON text of an object of numbers, {} for anything else."""
    return F.coalesce(
        F.from_json(json_text, "map<string,double>"), F.create_map().cast("map<string,double>")
    )


def spread(df: DataFrame) -> DataFrame:
    """Give every core some rows of a table stored in fewer pieces than there are cores.

    Larger tables already have more splits than that and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_narratives(spark: SparkSession, path: str) -> DataFrame:
    """(report_id, text) of the table that ``sinks.write_narratives`` wrote."""
    return spark.read.schema("report_id BIGINT, text STRING").parquet(path)


def read_narrative_files(spark: SparkSession, path: str) -> DataFrame:
    """(report_id, text) of the files that ``sinks.write_narrative_files`` wrote; whole files, one a row."""
    files = spark.read.schema("value STRING, report_id BIGINT").text(path, wholetext=True)
    return files.select("report_id", F.regexp_replace("value", r"\n\z", "").alias("text"))
