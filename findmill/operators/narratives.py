"""Packing of source files and narrative reports, scores and fallback texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findmill import vocab
from findmill.functions import text
from findmill.operators.documents import place


def packed_files(files: DataFrame) -> DataFrame:
    """Parts of the packed corpus of each report, one per file, in path order.

    Read in order of ``place`` they are the packed text.
    """
    first = files.groupBy("report_id").agg(F.min("path").alias("first_path"))
    gap = F.when(F.col("path") == F.col("first_path"), "").otherwise("\n\n")
    body = F.concat(gap, F.lit("FILE: "), "path", F.lit("\n```\n"), "content", F.lit("\n```"))
    return files.join(first, "report_id").select(
        "report_id", place(0, name=F.col("path")).alias("place"), body.alias("text")
    )


def packed_reports(narratives: DataFrame) -> DataFrame:
    """Six titled sections, each truncated, then truncated together (``packed``)."""
    sections = [
        F.concat(
            F.lit(f"## {title}\n"),
            text.truncate(F.coalesce(name, F.lit(vocab.NO_REPORT)), vocab.SECTION_CHARS),
        )
        for name, title, _ in vocab.NARRATIVES
    ]
    return narratives.withColumn(
        "packed", text.truncate(F.concat_ws("\n\n", *sections), vocab.TOTAL_CHARS)
    )


def final_scores(summaries: DataFrame, column: str = "final_summary") -> DataFrame:
    """Six scores found in the final text.  Without an overall score, the mean of the
    other positive ones stands in."""
    found = {
        f"{s}_score": text.labelled_score(F.col(column), f"{s.capitalize()} Score")
        for s in vocab.SCORES
    }
    others = F.array(*[F.col(f"{s}_score") for s in vocab.SCORES[1:]])
    overall = F.when(
        F.col("overall_score") == 0.0, F.coalesce(text.mean_of_positive(others), F.lit(0.0))
    ).otherwise(F.col("overall_score"))
    return summaries.withColumns(found).withColumn("overall_score", overall)


def fallback_summary(narratives: DataFrame) -> DataFrame:
    """Text assembled from the narratives when no final text exists (``final_summary``)."""

    def found(name: str) -> Column:
        return text.labelled_score(
            F.coalesce(f"{name}_report", F.lit("")), f"{name.capitalize()} Score"
        )

    def points(name: str, value: str) -> Column:
        own = F.col(value)
        whole = F.when(own == 0.0, F.col("overall")).otherwise(own)
        return F.concat(
            F.lit(f"- {name} Score: "), F.floor(whole).cast("bigint").cast("string"), F.lit("\n")
        )

    scored = narratives.withColumns({n: found(n) for n in ("quality", "security", "performance")})
    scored = scored.withColumn(
        "overall",
        F.coalesce(
            text.mean_of_positive(F.array("quality", "security", "performance")),
            F.lit(vocab.FALLBACK_SCORE),
        ),
    )
    sections = [
        F.when(
            F.col(name) != "",
            F.concat(
                F.lit(f"\n## {title}\n"),
                text.truncate(F.col(name), vocab.FALLBACK_SECTION_CHARS),
                F.lit("\n"),
            ),
        )
        for name, _, title in vocab.NARRATIVES
    ]
    summary = F.concat_ws(
        "\n",
        F.lit("# AI Code Review Report\n"),
        F.concat(F.lit("## 1. Overall Score: "), F.floor("overall").cast("string"), F.lit("\n")),
        F.lit("## 2. Score Breakdown\n"),
        points("Quality", "quality"),
        points("Security", "security"),
        points("Performance", "performance"),
        points("Maintainability", "quality"),
        points("Testing", "overall"),
        F.lit("\n## 3. Executive Summary\n"),
        F.lit(vocab.FALLBACK_INTRO + "\n"),
        *sections,
    )
    return scored.withColumn("final_summary", summary).drop(
        "quality", "security", "performance", "overall"
    )
