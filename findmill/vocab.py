"""Word lists, lookup tables, thresholds and texts.

These are data, not logic.  Results depend on them literally, so they are kept
together here in their natural order.
"""

from __future__ import annotations

# --- Fixed values: severities and sources -----------------------------------

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
SEVERITY_WEIGHT = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
UNKNOWN_SEVERITY_WEIGHT = 1
FINDING_SOURCES = ["static_analysis", "ai_detected", "ai_suspected"]
STATIC = "static_analysis"
AI = "ai_detected"

# --- Fixed values: corpus admission ------------------------------------------

IGNORED_DIRECTORIES = [".git", "node_modules", "venv", "build", "dist", "__pycache__"]
SOURCE_EXTENSIONS = ["py", "js", "ts", "java", "cpp", "cc", "cxx", "h", "hpp"]
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_EXTRACTED_BYTES = 100 * 1024 * 1024
LANGUAGE_BY_EXTENSION = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp",
}

# --- Fixed values: agent responses ---------------------------------------------

CONFIDENCE_ABSENT = 60
CONFIDENCE_INVALID = 50
TITLE_DEFAULT = "Untitled finding"
DESCRIPTION_DEFAULT = "No description provided."
IMPACT_DEFAULT = "Unknown impact."
RECOMMENDATION_DEFAULT = "Review this code."

# --- Fixed values: rule scanner ---------------------------------------------------

SCANNER_AGENT = "Static Analysis (Semgrep)"
SCANNER_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
SCANNER_CONFIDENCE = 80
SCANNER_TITLE = "[Semgrep] "
SCANNER_IMPACT = "Detected by Semgrep rule: "
SCANNER_RECOMMENDATION = (
    "Review the flagged code and remediate according to the "
    "rule description. Consult the rule metadata for CWE references."
)
CATEGORY_KEYWORDS = {
    "Security": [
        "eval", "security", "sql", "injection", "xss", "secret", "password", "passwd",
        "crypto", "auth", "command", "exec", "path", "traversal",
        "overflow", "format", "cwe", "rce", "deserializ",
    ],
    "Performance": ["perf", "performance", "n+1", "loop", "cache"],
    "Bug": [
        "null", "nullptr", "error", "exception", "crash", "bug",
        "check", "return", "malloc",
    ],
}
CATEGORY_OTHERWISE = "Quality"

# --- Fixed values: security-linter issues --------------------------------------------

LINTER_AGENT = "Static Analysis (Bandit)"
LINTER_SEVERITY = {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW"}
LINTER_CONFIDENCE = {"HIGH": 85, "MEDIUM": 65, "LOW": 45}
LINTER_CONFIDENCE_OTHERWISE = 60
LINTER_IMPACT = "Bandit test ID: %s. CWE: %s"
LINTER_RECOMMENDATION = "Review and remediate this security issue."

# --- Fixed values: complexity findings -------------------------------------------------

COMPLEXITY_AGENT = "Static Analysis (Radon)"
COMPLEXITY_FINDING_FROM = 15
COMPLEXITY_HIGH_FROM = 25
COMPLEX_FUNCTION_ABOVE = 10
COMPLEXITY_CONFIDENCE = 95
COMPLEXITY_TITLE = "High cyclomatic complexity in '%s' (CC=%d)"
COMPLEXITY_DESCRIPTION = (
    "Function '%s' has a cyclomatic complexity of %d. "
    "Values above 10 indicate complex, hard-to-test code. "
    "Values above 25 are considered very high risk."
)
COMPLEXITY_IMPACT = "Hard to test, maintain, and understand. Increases defect probability."
COMPLEXITY_RECOMMENDATION = (
    "Break this function into smaller, focused functions. "
    "Aim for cyclomatic complexity below 10."
)

# --- Fixed values: duplicate detection and merging ----------------------------------------

SIMILAR_TITLE = 0.65
SAME_TITLE_ANYWHERE = 0.85
BOOST_PER_FINDING = 10
BOOST_STATIC = 15
MAX_CONFIDENCE = 100
DESCRIPTIONS_KEPT = 3
TOP_FINDINGS = 5

# --- Fixed values: risk model ---------------------------------------------------------------

FEATURES = [
    "loc", "num_functions", "num_classes", "num_imports",
    "cyclomatic_complexity_avg", "max_nesting_depth", "avg_function_length",
    "comment_ratio", "num_static_findings", "num_llm_findings",
    "severity_weighted_score", "code_lines",
]
# (feature, [(lower bound, points), ...]) - first bound reached wins
RISK_POINTS_FROM = {
    "cyclomatic_complexity_avg": [(20, 25), (10, 15), (5, 5)],
    "loc": [(1000, 20), (500, 10), (200, 5)],
    "severity_weighted_score": [(20, 25), (10, 15), (5, 8)],
    "max_nesting_depth": [(5, 15), (3, 8)],
}
# (feature, [(upper bound, points), ...]) - first bound undercut wins
RISK_POINTS_BELOW = {"comment_ratio": [(0.05, 15), (0.1, 8)]}
RISK_POINTS_TOTAL = 100
PRIORITY_HIGH_FROM = 0.65
PRIORITY_MEDIUM_FROM = 0.35
HUMAN_REVIEW_PROBABILITY = 0.50
HUMAN_REVIEW_MAINTENANCE = 0.60
# threshold factors, in reporting order: (feature, comparison, bound, text)
THRESHOLD_FACTORS = [
    ("cyclomatic_complexity_avg", ">=", 10, "High cyclomatic complexity"),
    ("loc", ">=", 500, "Large file size"),
    ("severity_weighted_score", ">=", 10, "High-severity findings detected"),
    ("comment_ratio", "<", 0.08, "Low documentation/comment ratio"),
    ("max_nesting_depth", ">=", 4, "Deep code nesting"),
    ("avg_function_length", ">=", 50, "Long function bodies"),
    ("num_imports", ">=", 20, "High number of dependencies"),
]
NO_FACTORS = "Metrics within acceptable ranges"
MAX_FACTORS = 5
MIN_CONTRIBUTION = 0.01
CONTRIBUTION_LABELS = {
    "cyclomatic_complexity_avg": "High cyclomatic complexity",
    "loc": "Large file size (many lines of code)",
    "severity_weighted_score": "High-severity issues detected",
    "num_static_findings": "Multiple static analysis issues",
    "num_llm_findings": "Multiple AI-detected issues",
    "max_nesting_depth": "Deep code nesting",
    "avg_function_length": "Long function bodies",
    "comment_ratio": "Low comment/documentation ratio",
    "num_imports": "High number of dependencies",
    "num_functions": "Large number of functions",
    "num_classes": "Large number of classes",
    "code_lines": "Large code base",
}
MODEL_VERSION = "1.0"
MODEL_HEURISTIC = "heuristic_fallback"
MODEL_TRAINED = "xgboost_kc1"
RISK_DISCLAIMER = (
    "Risk prediction is based on statistical patterns in code metrics from the KC1 "
    "NASA defect dataset. It indicates likelihood of issues, not certainty. "
    "Always apply human judgment before acting on these results."
)
LABEL_FALSE_TEXTS = ["false", "0", "f", ""]

# --- Fixed values: training ---------------------------------------------------------------------

TREES = 200
PATIENCE = 20
TREE_DEPTH = 5
LEARNING_RATE = 0.05
ROW_SHARE = 0.8
FEATURE_SHARE = 0.8

# --- Fixed values: report texts --------------------------------------------------------------------

SECTION_CHARS = 25_000
TOTAL_CHARS = 90_000
FALLBACK_SECTION_CHARS = 4_000
FALLBACK_SCORE = 75.0
TRUNCATION_NOTICE = "\n\n[... report truncated for length ...]"
NO_REPORT = "No report available."
# (column, packed title, fallback title)
NARRATIVES = [
    ("quality_report", "Code Quality Report", "Code Quality"),
    ("bug_report", "Bug Detection Report", "Bug Detection"),
    ("security_report", "Security Report", "Security"),
    ("performance_report", "Performance Report", "Performance"),
    ("refactoring_report", "Refactoring Report", "Refactoring"),
    ("documentation_report", "Documentation Report", "Documentation"),
]
SCORES = ["overall", "quality", "security", "performance", "maintainability", "testing"]
FALLBACK_INTRO = (
    "All specialized code review agents completed their analysis. "
    "The consolidated report below summarizes findings across code quality, security, "
    "performance, and maintainability."
)
SEVERITY_BADGE = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "INFO": "ℹ️"}
BADGE_OTHERWISE = "⚪"
SCORE_BANDS = [(80, "great"), (65, "good"), (45, "warn")]
SCORE_BAND_OTHERWISE = "bad"
