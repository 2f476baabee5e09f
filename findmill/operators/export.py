"""JSON and Markdown exports of stored reports, as document parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findmill import vocab
from findmill.functions import labels
from findmill.functions.rounding import round_exact
from findmill.operators.documents import PAGE, place
from findmill.sources.tables import text_list

_KEEP_NULLS = {"ignoreNullFields": "false"}

# Exported finding fields and the stored columns behind them
EXPORTED = [
    ("id", "finding_id"), ("agent", "agent"), ("category", "category"),
    ("severity", "severity"), ("confidence", "confidence"), ("source", "source"),
    ("file", "file"), ("line_start", "line_start"), ("line_end", "line_end"),
    ("title", "title"), ("description", "description"), ("impact", "impact"),
    ("recommendation", "recommendation"), ("code_snippet", "code_snippet"),
    ("suggested_fix", "suggested_fix"),
]


def exported_findings(findings: DataFrame) -> DataFrame:
    """Findings with the export's column names."""
    return findings.select("report_id", *[F.col(old).alias(new) for new, old in EXPORTED])


def _iso(ts: Column) -> Column:
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", "").otherwise(fraction),
    )


def _paged(rows: DataFrame, order: list[str], separator: str) -> DataFrame:
    """Join the ``text`` of findings into pages: consecutive in (order, id), each of at
    most PAGE ids."""
    keys = ["report_id", *order, "page"]
    return (
        rows.withColumn("page", F.floor(F.col("id") / PAGE))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("page_rows"))
        .select(*keys, F.array_join(F.transform("page_rows", lambda r: r["text"]), separator).alias("text"))
    )


def json_parts(reports: DataFrame, findings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Parts of one JSON document per report; findings by confidence, highest first."""
    c = F.col
    total = c("critical_count") + c("high_count") + c("medium_count") + c("low_count") + c("info_count")
    scores = F.struct(
        c("overall_score").alias("overall"),
        *[c(f"{s}_score").alias(s) for s in vocab.SCORES[1:]],
    )
    counts = F.struct(
        *[c(f"{s.lower()}_count").alias(s.lower()) for s in vocab.SEVERITIES], total.alias("total")
    )
    head_json = F.to_json(
        F.struct(
            c("id").alias("report_id"), "repository_id", _iso(c("created_at")).alias("created_at"),
            "overall_score", scores.alias("scores"), counts.alias("finding_counts"),
        ),
        _KEEP_NULLS,
    )
    head = reports.select(
        c("id").alias("report_id"),
        place(0).alias("place"),
        F.concat(F.regexp_replace(head_json, r"\}\z", ""), F.lit(',"findings":[')).alias("text"),
    )
    rows = findings.select(
        "report_id", "id", (-c("confidence")).alias("minor"),
        F.to_json(F.struct(*[c(old).alias(new) for new, old in EXPORTED]), _KEEP_NULLS).alias("text"),
    )
    pages = _paged(rows, ["minor"], ",")
    first = pages.groupBy("report_id").agg(F.min(F.struct("minor", "page")).alias("first"))
    comma = F.when(F.struct("minor", "page") == c("first"), "").otherwise(",")
    body = (
        pages.join(first, "report_id")
        .join(reports.select(c("id").alias("report_id")), "report_id", "left_semi")
        .select(
            "report_id",
            place(1, 0, c("minor"), c("page")).alias("place"),
            F.concat(comma, "text").alias("text"),
        )
    )
    risk = predictions.select(
        "report_id",
        F.struct(
            "defect_probability", "maintenance_risk", "review_priority", "human_review_recommended",
            text_list(c("top_risk_factors")).alias("top_risk_factors"), "model_used", "disclaimer",
        ).alias("ml_prediction"),
    )
    tail_json = F.to_json(F.struct("ml_prediction", c("summary").alias("final_narrative")), _KEEP_NULLS)
    tail = (
        reports.select(c("id").alias("report_id"), "summary")
        .join(risk, "report_id", "left")
        .select(
            "report_id", place(2).alias("place"),
            F.concat(F.lit("],"), F.regexp_replace(tail_json, r"^\{", "")).alias("text"),
        )
    )
    return head.unionByName(body).unionByName(tail)


def _line(label: str, value) -> Column:
    return F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))


def _lines(*items) -> Column:
    """Text lines, each ended by a line feed; NULL items are left out."""
    columns = [i if isinstance(i, Column) else F.lit(i) for i in items]
    kept = F.array_compact(F.array(*columns))
    return F.array_join(F.transform(kept, lambda s: F.concat(s, F.lit("\n"))), "")


def markdown_parts(reports: DataFrame, findings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Parts of one Markdown document per report; findings by severity, then confidence.

    Headings, labels and table layout are the fixed report format.
    """
    c = F.col

    def score(name: str) -> Column:
        points = round_exact(c(f"{name}_score"), 0).cast("bigint").cast("string")
        return _line(name.capitalize(), F.concat(points, F.lit(" / 100")))

    def badge(severity: str, icon: str) -> Column:
        return _line(f"{icon} {severity.capitalize()}", c(f"{severity.lower()}_count").cast("string"))

    head = reports.select(
        c("id").alias("report_id"),
        place(0).alias("place"),
        _lines(
            "# AI Code Review Report", "",
            F.concat(F.lit("**Report ID:** "), c("id").cast("string")),
            F.concat(F.lit("**Date:** "), F.date_format("created_at", "yyyy-MM-dd HH:mm 'UTC'")),
            "", "---", "", "## 1. Executive Summary", "",
            "| Metric | Score |", "|--------|-------|",
            *[score(s) for s in vocab.SCORES],
            "", "### Issue Counts", "", "| Severity | Count |", "|----------|-------|",
            *[badge(s, icon) for s, icon in vocab.SEVERITY_BADGE.items()],
            "", "---", "",
        ).alias("text"),
    )

    def percent(name: str) -> Column:
        return F.format_string("%.1f%%", round_exact(c(name) * 100, 1))

    factors = F.array_join(
        F.transform(text_list(c("top_risk_factors")), lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), ""
    )
    risk = predictions.join(reports.select(c("id").alias("report_id")), "report_id", "left_semi").select(
        "report_id",
        place(1).alias("place"),
        F.concat(
            _lines(
                "## 2. ML Code Risk Prediction", "",
                F.concat(F.lit("> ⚠️ "), "disclaimer"), "",
                "| Metric | Value |", "|--------|-------|",
                _line("Defect Probability", percent("defect_probability")),
                _line("Maintenance Risk", percent("maintenance_risk")),
                _line("Review Priority", c("review_priority")),
                _line(
                    "Human Review Recommended",
                    F.when(c("human_review_recommended"), "✅ Yes").otherwise("❌ No"),
                ),
                "", "**Top Risk Factors:**",
            ),
            factors,
            _lines("", "---", ""),
        ).alias("text"),
    )
    title = reports.select(
        c("id").alias("report_id"), place(2).alias("place"), _lines("## 3. Findings", "").alias("text")
    )
    span = F.when(
        c("line_start") != 0,
        F.concat(
            F.lit("Lines "), c("line_start").cast("string"), F.lit("–"),
            F.coalesce(c("line_end").cast("string"), F.lit("None")),
        ),
    )
    where = F.when(
        c("file") != "",
        F.concat(F.lit("**Location:** `"), "file", F.lit("` ("), F.coalesce(span, F.lit("unknown line")), F.lit(")  ")),
    )

    def block(column: str, heading: str) -> Column:
        return F.when(
            c(column) != "", F.concat(F.lit(f"\n{heading}\n```\n"), column, F.lit("\n```"))
        )

    rows = findings.select(
        "report_id", "id",
        labels.severity_order(c("severity")).cast("bigint").alias("major"),
        (-c("confidence")).alias("minor"),
        _lines(
            F.concat(
                F.lit("### "), labels.lookup(c("severity"), vocab.SEVERITY_BADGE, F.lit(vocab.BADGE_OTHERWISE)),
                F.lit(" ["), "severity", F.lit("] "), "title",
            ),
            "",
            F.concat(F.lit("**Agent:** "), "agent", F.lit("  ")),
            F.concat(F.lit("**Category:** "), "category", F.lit("  ")),
            F.concat(F.lit("**Confidence:** "), c("confidence").cast("string"), F.lit("%  ")),
            where,
            "", F.concat(F.lit("**Description:** "), "description"),
            "", F.concat(F.lit("**Impact:** "), "impact"),
            "", F.concat(F.lit("**Recommendation:** "), "recommendation"),
            block("code_snippet", "**Code:**"),
            block("suggested_fix", "**Suggested Fix (AI-generated):**"),
            "", "---", "",
        ).alias("text"),
    )
    body = (
        _paged(rows, ["major", "minor"], "")
        .join(reports.select(c("id").alias("report_id")), "report_id", "left_semi")
        .select("report_id", place(3, c("major"), c("minor"), c("page")).alias("place"), "text")
    )
    tail = reports.select(
        c("id").alias("report_id"), place(4).alias("place"),
        F.concat(F.lit("## 4. Full Analysis\n\n"), F.coalesce("summary", F.lit(""))).alias("text"),
    )
    return head.unionByName(risk).unionByName(title).unionByName(body).unionByName(tail)
