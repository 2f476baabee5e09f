"""Defect dataset (CSV of module metrics) -> the twelve model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from findmill import vocab

# The columns read
COLUMNS = ["loc", "v(g)", "n", "lOCode", "lOComment", "branchCount", "total_Op", "uniq_Op"]


def read_defects(spark: SparkSession, path: str) -> DataFrame:
    """(features..., label) of a CSV with a header; every column is read as text."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return defect_features(raw)


def defect_features(raw: DataFrame) -> DataFrame:
    """Features and label of text columns; a row with a non-number is skipped."""
    for name in [*COLUMNS, "defects"]:
        if name not in raw.columns:
            default = "false" if name == "defects" else None
            raw = raw.withColumn(name, F.lit(default).cast("string"))

    def text(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"`{name}`"), F.lit("")), F.lit("0"))

    numbers = raw.select(
        *[text(n).try_cast(T.DoubleType()).alias(n.replace("(", "").replace(")", "")) for n in COLUMNS],
        "defects",
    ).dropna(subset=[n.replace("(", "").replace(")", "") for n in COLUMNS])
    c = F.col
    return numbers.select(
        c("loc"),
        (c("total_Op") / 10).alias("num_functions"),
        (c("uniq_Op") / 5).alias("num_classes"),
        (c("n") / 50).alias("num_imports"),
        c("vg").alias("cyclomatic_complexity_avg"),
        (c("vg") / 5).alias("max_nesting_depth"),
        (c("loc") / F.greatest(c("total_Op") / 10, F.lit(1.0))).alias("avg_function_length"),
        F.when(c("loc") > 0, c("lOComment") / c("loc")).otherwise(0.0).alias("comment_ratio"),
        (c("branchCount") / 10).alias("num_static_findings"),
        (c("vg") / 3).alias("num_llm_findings"),
        (c("branchCount") * 2 + c("vg")).alias("severity_weighted_score"),
        c("lOCode").alias("code_lines"),
        (~F.lower(F.coalesce(c("defects"), F.lit(""))).isin(vocab.LABEL_FALSE_TEXTS))
        .cast("int").alias("label"),
    )
