"""Registered queries of the whole review: source files and agent responses in, results out."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill.plans.catalog_files import RISK_SQL
from findmill.plans.review import review
from findmill.plans.views import cte, view


def _review(spark, d):
    return review(view(spark, d, "source_files").drop("doc_id"), view(spark, d, "responses"))


def _findings(spark, d):
    return _review(spark, d).findings.withColumn("merged_from", F.array_join("merged_from", ","))


def _risk(spark, d):
    return _review(spark, d).predictions.select(
        "report_id", "defect_probability", "maintenance_risk", "review_priority",
        "human_review_recommended", F.array_join("top_risk_factors", "; ").alias("top_risk_factors"), "model_used",
    )


# in a review the features see the findings of the metrics step
_OWN_FINDINGS = """, findings AS (SELECT report_id, 'static_analysis' AS source,
   CASE WHEN cc >= 25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
   FROM blocks JOIN source_files USING (doc_id) WHERE is_function AND cc >= 15), totals AS"""
_REVIEW_RISK_SQL = RISK_SQL.replace(cte("findings").rstrip() + ", source_files", "WITH source_files", 1).replace(
    ", totals AS", _OWN_FINDINGS, 1
)

QUERIES = {
    "review_findings": (_findings, None),
    "review_risk": (_risk, _REVIEW_RISK_SQL),
}
