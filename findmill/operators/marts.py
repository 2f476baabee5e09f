"""Report marts: ownership, listings, counts, dashboards and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from findmill import vocab
from findmill.functions import labels
from findmill.functions.rounding import round_exact
from findmill.operators.ordering import top_findings
from findmill.sources.tables import number_map, text_list

_COUNTS = [f"{s.lower()}_count" for s in vocab.SEVERITIES]


# --- filters ---------------------------------------------------------------------


def filter_findings(
    findings: DataFrame,
    severity: str | None = None,
    category: str | None = None,
    agent: str | None = None,
) -> DataFrame:
    """Optional filters: severity equals the upper-cased argument, category and agent
    contain theirs in any case.  '%' and '_' in an argument act as wildcards."""
    if severity:
        findings = findings.filter(F.col("severity") == severity.upper())
    if category:
        findings = findings.filter(F.col("category").ilike(f"%{category}%"))
    if agent:
        findings = findings.filter(F.col("agent").ilike(f"%{agent}%"))
    return findings


def static_evidence(findings: DataFrame) -> DataFrame:
    return findings.filter(labels.is_static_evidence(F.col("source"), F.col("agent")))


def list_findings(findings: DataFrame, tie: str = "id") -> DataFrame:
    """Most confident first, within each report."""
    return findings.orderBy("report_id", F.col("confidence").desc(), tie)


# --- ownership -------------------------------------------------------------------


def user_repositories(repositories: DataFrame, user_id: int | None = None) -> DataFrame:
    """Repositories without their archive path, newest first; of one user or of all."""
    if user_id is not None:
        repositories = repositories.filter(F.col("user_id") == user_id)
    return repositories.select("user_id", "id", "repository_name", "uploaded_at").orderBy(
        "user_id", F.col("uploaded_at").desc(), F.col("id").desc()
    )


def public_users(users: DataFrame) -> DataFrame:
    """Users without their password hash."""
    return users.select("id", "name", "email", "created_at")


def owned_reports(
    reports: DataFrame, repositories: DataFrame, user_id: int | None = None
) -> DataFrame:
    """Reports with their owner; with ``user_id`` only that user's."""
    if user_id is not None:
        repositories = repositories.filter(F.col("user_id") == user_id)
    owners = repositories.select(F.col("id").alias("repository_id"), "user_id", "repository_name")
    return reports.join(owners, "repository_id")


def user_reports(
    reports: DataFrame, repositories: DataFrame, user_id: int | None = None
) -> DataFrame:
    """Reports of one user (or of all), newest first."""
    return owned_reports(reports, repositories, user_id).orderBy(
        "user_id", F.col("created_at").desc(), F.col("id").desc()
    )


def owned_findings(
    findings: DataFrame, reports: DataFrame, repositories: DataFrame, user_id: int
) -> DataFrame:
    """Findings of the reports one user owns."""
    owned = owned_reports(reports, repositories, user_id).select(F.col("id").alias("report_id"))
    return findings.join(owned, "report_id", "left_semi")


# --- counts ----------------------------------------------------------------------


def severity_counts(findings: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Findings per severity and in all, per report; zeros for ``reports`` without any."""
    counts = findings.groupBy("report_id").agg(
        *[F.count_if(F.col("severity") == s).alias(c) for s, c in zip(vocab.SEVERITIES, _COUNTS)],
        F.count("*").alias("total"),
    )
    if reports is None:
        return counts
    ids = reports.select(F.col("id").alias("report_id"))
    return ids.join(counts, "report_id", "left").fillna(0, [*_COUNTS, "total"])


def issue_totals(reports: DataFrame) -> DataFrame:
    """Totals of the stored counts: the list view leaves INFO out, the export does not."""
    listed = sum((F.col(c) for c in _COUNTS[1:-1]), F.col(_COUNTS[0]))
    return reports.select(
        F.col("id").alias("report_id"),
        listed.alias("listed_total"),
        (listed + F.col("info_count")).alias("export_total"),
        labels.score_band(F.col("overall_score")).alias("score_band"),
    )


def dashboard(reports: DataFrame, repositories: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: reports, mean overall score to one decimal, critical and high findings.

    Reports are summed per repository before the join.
    """
    per_repository = reports.groupBy(F.col("repository_id").alias("id")).agg(
        F.count("*").alias("num_reports"),
        F.sum("overall_score").alias("score_total"),
        F.sum("critical_count").alias("critical_total"),
        F.sum("high_count").alias("high_total"),
    )
    stats = (
        repositories.select("id", "user_id")
        .join(per_repository, "id")
        .groupBy("user_id")
        .agg(
            *[F.sum(c).alias(c) for c in ("num_reports", "score_total", "critical_total", "high_total")]
        )
        .withColumn("avg_score", round_exact(F.col("score_total") / F.col("num_reports"), 1, ties_up=True))
        .drop("score_total")
    )
    return users.select(F.col("id").alias("user_id")).join(stats, "user_id", "left").fillna(0)


def agent_summaries(findings: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Findings per report and agent, with seconds where ``timings`` has them."""
    counts = findings.groupBy("report_id", "agent").agg(F.count("*").alias("finding_count"))
    if timings is None:
        return counts.withColumns(
            {"execution_time_seconds": F.lit(None).cast("double"), "status": F.lit("completed")}
        )
    return (
        counts.join(timings, ["report_id", "agent"], "full")
        .fillna(0, ["finding_count"])
        .withColumn("status", F.lit("completed"))
    )


# --- summaries -------------------------------------------------------------------


def review_summaries(reports: DataFrame, findings: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per report: scores, finding totals, and the risk where there is one."""
    counts = severity_counts(findings, reports)
    risk = predictions.select(
        "report_id",
        F.col("review_priority").alias("ml_risk_priority"),
        F.col("defect_probability").alias("ml_defect_probability"),
        "human_review_recommended",
    )
    scores = [F.col("overall_score")] + [F.col(f"{s}_score") for s in vocab.SCORES[1:]]
    return (
        reports.select(F.col("id").alias("report_id"), "repository_id", *scores)
        .join(counts, "report_id", "left")
        .withColumnRenamed("total", "finding_count")
        .drop("info_count")
        .join(risk, "report_id", "left")
    )


def report_predictions(reports: DataFrame, predictions: DataFrame) -> DataFrame:
    """The prediction of each report, or NULLs; JSON texts become arrays and maps."""
    parsed = predictions.drop("id").withColumns(
        {
            "top_risk_factors": text_list(F.col("top_risk_factors")),
            "shap_values": number_map(F.col("shap_values")),
        }
    )
    return reports.select(F.col("id").alias("report_id")).join(parsed, "report_id", "left")


def report_details(
    reports: DataFrame,
    repositories: DataFrame,
    analysis_results: DataFrame,
    findings: DataFrame,
    predictions: DataFrame,
    user_id: int | None = None,
) -> DataFrame:
    """One row per owned report with its one-to-one children, finding count and top five.

    All its findings stay rows of their own (``owned_findings``): a report may have more
    than fit one row.
    """
    head = owned_reports(reports, repositories, user_id).withColumnRenamed("id", "report_id")
    # the planner takes long texts for short ones: sorted and merged, they never go through the driver
    owned = analysis_results.drop("id").join(head.select("report_id"), "report_id", "left_semi")
    narratives = owned.hint("merge")
    totals = findings.groupBy("report_id").agg(F.count("*").alias("num_findings"))
    top = (
        top_findings(findings, tie="id")
        .groupBy("report_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "finding_id", "severity", "confidence", "title"))
            ).alias("top_issues")
        )
    )
    return (
        head.join(narratives, "report_id", "left")
        .join(predictions.drop("id"), "report_id", "left")
        .join(totals, "report_id", "left")
        .join(top, "report_id", "left")
        .fillna(0, ["num_findings"])
    )
