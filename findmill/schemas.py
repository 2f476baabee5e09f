"""Table schemas.  An absent value is NULL, never 0 or ''."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SOURCE_FILES = _struct("report_id BIGINT, path STRING, content STRING")

FINDINGS = _struct(
    "report_id BIGINT, ord BIGINT, id STRING, agent STRING, category STRING, severity STRING, "
    "confidence BIGINT, source STRING, file STRING, line_start BIGINT, line_end BIGINT, "
    "title STRING, description STRING, impact STRING, recommendation STRING, "
    "code_snippet STRING, suggested_fix STRING, merged_from ARRAY<STRING>"
)

USERS = _struct(
    "id BIGINT, name STRING, email STRING, password STRING, created_at TIMESTAMP_NTZ"
)
REPOSITORIES = _struct(
    "id BIGINT, user_id BIGINT, repository_name STRING, zip_path STRING, "
    "uploaded_at TIMESTAMP_NTZ"
)
REPORTS = _struct(
    "id BIGINT, repository_id BIGINT, overall_score DOUBLE, summary STRING, "
    "created_at TIMESTAMP_NTZ, quality_score DOUBLE, security_score DOUBLE, "
    "performance_score DOUBLE, maintainability_score DOUBLE, testing_score DOUBLE, "
    "critical_count BIGINT, high_count BIGINT, medium_count BIGINT, low_count BIGINT, "
    "info_count BIGINT"
)
ANALYSIS_RESULTS = _struct(
    "id BIGINT, report_id BIGINT, quality_report STRING, security_report STRING, "
    "performance_report STRING, bug_report STRING, refactoring_report STRING, "
    "documentation_report STRING"
)
STORED_FINDINGS = _struct(
    "id BIGINT, report_id BIGINT, finding_id STRING, agent STRING, category STRING, "
    "severity STRING, confidence BIGINT, source STRING, file STRING, line_start BIGINT, "
    "line_end BIGINT, title STRING, description STRING, impact STRING, "
    "recommendation STRING, code_snippet STRING, suggested_fix STRING, merged_from STRING"
)
PREDICTIONS = _struct(
    "id BIGINT, report_id BIGINT, defect_probability DOUBLE, maintenance_risk DOUBLE, "
    "review_priority STRING, human_review_recommended BOOLEAN, top_risk_factors STRING, "
    "shap_values STRING, model_version STRING, model_used STRING, disclaimer STRING"
)

TABLES = {
    "users": USERS,
    "repositories": REPOSITORIES,
    "reports": REPORTS,
    "analysis_results": ANALYSIS_RESULTS,
    "findings": STORED_FINDINGS,
    "ml_predictions": PREDICTIONS,
}

# Parent key of each table (child, key, parent), unique keys, text limits
FOREIGN_KEYS = [
    ("repositories", "user_id", "users"),
    ("reports", "repository_id", "repositories"),
    ("analysis_results", "report_id", "reports"),
    ("findings", "report_id", "reports"),
    ("ml_predictions", "report_id", "reports"),
]
UNIQUE_KEYS = [
    ("users", "email"),
    ("analysis_results", "report_id"),
    ("ml_predictions", "report_id"),
]
TEXT_LIMITS = [
    ("users", "name", 100),
    ("users", "email", 255),
    ("users", "password", 255),
    ("repositories", "repository_name", 255),
    ("repositories", "zip_path", 500),
    ("findings", "finding_id", 100),
    ("findings", "agent", 200),
    ("findings", "category", 100),
    ("findings", "severity", 20),
    ("findings", "source", 50),
    ("findings", "file", 500),
    ("findings", "title", 500),
    ("ml_predictions", "review_priority", 20),
    ("ml_predictions", "model_version", 20),
    ("ml_predictions", "model_used", 50),
]
