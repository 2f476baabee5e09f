"""Schema validation of findings: good rows and a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from findmill import vocab

# Columns a finding must have
REQUIRED = [
    "id", "agent", "category", "severity", "confidence",
    "title", "description", "impact", "recommendation",
]


def with_reject_reason(findings: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first rule a row breaks, NULL for a valid row."""
    reason = F
    for name in REQUIRED:
        reason = reason.when(F.col(name).isNull(), f"missing {name}")
    reason = (
        reason.when(~F.col("severity").isin(vocab.SEVERITIES), "unknown severity")
        .when(~F.col("confidence").between(0, 100), "confidence out of range")
        .when(~F.col("source").isin(vocab.FINDING_SOURCES), "unknown source")
    )
    return findings.withColumn("reject_reason", reason)


def valid_findings(findings: DataFrame) -> DataFrame:
    """Valid rows, those without a ``reject_reason``; a missing source counts as AI-detected."""
    # plain conditions, which the scan of a stored table can use, instead of the reason worked out a row
    known = F.col("source").isNull() | F.col("source").isin(vocab.FINDING_SOURCES)
    for name in REQUIRED:
        known &= F.col(name).isNotNull()
    valid = known & F.col("severity").isin(vocab.SEVERITIES) & F.col("confidence").between(0, 100)
    return findings.filter(valid).withColumn("source", F.coalesce("source", F.lit(vocab.AI)))


def rejected_findings(findings: DataFrame) -> DataFrame:
    return with_reject_reason(findings).filter("reject_reason IS NOT NULL")


def file_counts(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Source files per report; ``is_empty`` flags reports without any."""
    counts = files.groupBy("report_id").agg(F.count("*").alias("num_files"))
    n = F.coalesce("num_files", F.lit(0))
    return reports.select("report_id").join(counts, "report_id", "left").select(
        "report_id", n.alias("num_files"), (n == 0).alias("is_empty")
    )
