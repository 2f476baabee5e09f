"""Registered queries over source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill import rulepack
from findmill.functions import paths
from findmill.operators import metrics, narratives, risk, rules, validation
from findmill.plans.views import cte, view
from findmill.session import durable
from findmill.sources import files as corpus

_LINES_SQL = """lines AS (SELECT report_id, path, doc_id, unnest(all_lines) AS line,
   generate_subscripts(all_lines, 1) AS no FROM (
   SELECT *, string_split(CASE WHEN content LIKE concat('%', chr(10)) THEN left(content, -1) ELSE content END, chr(10))
     AS all_lines FROM source_files WHERE content <> ''))"""

_LINE_COUNTS_SQL = f""", {_LINES_SQL},
 counted AS (SELECT doc_id, count(*) AS loc,
   count(*) FILTER (WHERE regexp_full_match(line, '\\s*')) AS blank_lines,
   count(*) FILTER (WHERE regexp_matches(line, '^\\s*(#|//|/\\*|\\*|''''''|\"\"\")')) AS comment_lines
  FROM lines GROUP BY doc_id),
 line_metrics AS (SELECT report_id, path, coalesce(loc, 0) AS loc, coalesce(blank_lines, 0) AS blank_lines,
   coalesce(comment_lines, 0) AS comment_lines,
   coalesce(loc - blank_lines - comment_lines, 0) AS code_lines,
   coalesce(CAST(format('{{:.3f}}', comment_lines / loc) AS DOUBLE), 0.0::DOUBLE) AS comment_ratio
  FROM source_files LEFT JOIN counted USING (doc_id))"""

_STRUCTURE_SQL = r""",
 py AS (SELECT *, strlen(regexp_extract(line, '^[ \t]*')) AS indent,
   NOT regexp_full_match(line, '\s*') AND NOT regexp_matches(line, '^\s*#') AS counts,
   regexp_matches(line, '^\s*(async\s+)?(def|class)\s') AS header,
   regexp_matches(line, '^\s*(async\s+)?def\s') AS is_function,
   len(regexp_extract_all(regexp_replace(line, '"[^"]*"|''[^'']*''|#.*', '', 'g'),
     '\b(if|elif|for|while|except|and|or|assert)\b')) AS decisions
  FROM lines WHERE path LIKE '%.py'),
 malformed AS (SELECT DISTINCT doc_id FROM py WHERE header AND (
   regexp_matches(line, '^\s*(async\s+)?def\s+[A-Za-z_]\w*\s*[(\[]\s*:')
   OR NOT regexp_matches(line, '^\s*((async\s+)?def\s+[A-Za-z_]\w*\s*[(\[]|class\s+[A-Za-z_]\w*\s*[:(\[])'))),
 code AS (SELECT * FROM py WHERE counts AND doc_id NOT IN (SELECT doc_id FROM malformed)),
 opened AS (SELECT h.doc_id, h.no, h.indent, h.is_function, h.line,
   (SELECT min(l.no) FROM code l WHERE l.doc_id = h.doc_id AND l.no > h.no AND l.indent <= h.indent) AS stop
  FROM code h WHERE h.header),
 closed AS (SELECT o.*, (SELECT max(l.no) FROM code l WHERE l.doc_id = o.doc_id AND (o.stop IS NULL OR l.no < o.stop)) AS last_no
  FROM opened o),
 owned AS (SELECT l.doc_id, l.no, l.decisions, max(b.no) AS owner FROM code l JOIN closed b
   ON b.doc_id = l.doc_id AND b.no < l.no AND l.no <= b.last_no WHERE NOT l.header AND l.decisions > 0 GROUP BY ALL),
 blocks AS (SELECT c.doc_id, c.no, c.last_no, c.is_function,
   regexp_extract(c.line, '(?:def|class)\s+([A-Za-z_]\w*)', 1) AS name,
   1 + (SELECT count(*) FROM closed o WHERE o.doc_id = c.doc_id AND o.no < c.no AND c.no <= o.last_no) AS depth,
   1 + coalesce((SELECT sum(d.decisions) FROM owned d WHERE d.doc_id = c.doc_id AND d.owner = c.no), 0) AS cc
  FROM closed c),
 imports AS (SELECT doc_id, count(*) AS n FROM py
   WHERE regexp_matches(line, '^\s*(import\s+\w|from\s+\S+\s+import\b)') GROUP BY doc_id),
 per_doc AS (SELECT doc_id, count(*) FILTER (WHERE is_function) AS fns, count(*) FILTER (WHERE NOT is_function) AS classes,
   max(depth) AS depth, sum(last_no - no) FILTER (WHERE is_function) AS lengths, sum(cc) FILTER (WHERE is_function) AS ccs,
   max(cc) FILTER (WHERE is_function) AS peak, count(*) FILTER (WHERE is_function AND cc > 10) AS many
  FROM blocks GROUP BY doc_id),
 structure AS (SELECT f.report_id, f.path,
   coalesce(fns, 0) AS num_functions, coalesce(classes, 0) AS num_classes, coalesce(i.n, 0) AS num_imports,
   coalesce(depth, 0) AS max_nesting_depth, coalesce(lengths / nullif(fns, 0), 0.0)::DOUBLE AS avg_function_length,
   CAST(format('{:.2f}', coalesce(ccs / nullif(fns, 0), 0.0)::DOUBLE) AS DOUBLE) AS cyclomatic_complexity_avg,
   CAST(coalesce(peak, 0) AS BIGINT) AS cyclomatic_complexity_max, coalesce(many, 0) AS num_complex_functions
  FROM source_files f LEFT JOIN per_doc USING (doc_id) LEFT JOIN imports i USING (doc_id)
  WHERE f.path LIKE '%.py' AND f.doc_id NOT IN (SELECT doc_id FROM malformed)) """

_METRICS_SQL = cte("source_files") + _LINE_COUNTS_SQL + _STRUCTURE_SQL + """, file_metrics AS (
  SELECT * FROM line_metrics LEFT JOIN structure USING (report_id, path)) """

_REPORT_SQL = _METRICS_SQL + """, report_metrics AS (SELECT report_id,
   CAST(sum(loc) AS BIGINT) AS total_loc, CAST(coalesce(sum(num_functions), 0) AS BIGINT) AS total_functions,
   CAST(coalesce(sum(num_classes), 0) AS BIGINT) AS total_classes,
   CAST(coalesce(sum(num_imports), 0) AS BIGINT) AS total_imports,
   CAST(format('{:.2f}', coalesce(avg(cyclomatic_complexity_avg), 0)) AS DOUBLE) AS avg_cyclomatic_complexity,
   count(*) AS num_files_analyzed, CAST(sum(code_lines) AS BIGINT) AS code_lines,
   coalesce(max(max_nesting_depth), 0) AS max_nesting_depth,
   round(coalesce(avg(nullif(avg_function_length, 0)), 0), 6) AS avg_function_length,
   round(avg(comment_ratio), 6) AS comment_ratio FROM file_metrics GROUP BY report_id) """

_FEATURES_SQL = (
    _REPORT_SQL.replace("WITH source_files", cte("findings").rstrip() + ", source_files", 1)
    + """, totals AS (SELECT report_id, count(*) FILTER (WHERE source = 'static_analysis') AS st,
   count(*) FILTER (WHERE source <> 'static_analysis') AS other,
   sum(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS w
   FROM findings GROUP BY report_id),
 features AS (SELECT report_id, coalesce(total_loc, 0)::DOUBLE AS loc,
   coalesce(total_functions, 0)::DOUBLE AS num_functions, coalesce(total_classes, 0)::DOUBLE AS num_classes,
   coalesce(total_imports, 0)::DOUBLE AS num_imports,
   coalesce(avg_cyclomatic_complexity, 0)::DOUBLE AS cyclomatic_complexity_avg,
   coalesce(max_nesting_depth, 0)::DOUBLE AS max_nesting_depth,
   coalesce(avg_function_length, 0)::DOUBLE AS avg_function_length,
   coalesce(comment_ratio, 0)::DOUBLE AS comment_ratio, coalesce(st, 0)::DOUBLE AS num_static_findings,
   coalesce(other, 0)::DOUBLE AS num_llm_findings, coalesce(w, 0)::DOUBLE AS severity_weighted_score,
   coalesce(code_lines, 0)::DOUBLE AS code_lines
  FROM report_metrics FULL JOIN totals USING (report_id)) """
)

RISK_SQL = _FEATURES_SQL + """, points AS (SELECT *,
   CASE WHEN cyclomatic_complexity_avg >= 20 THEN 25 WHEN cyclomatic_complexity_avg >= 10 THEN 15
     WHEN cyclomatic_complexity_avg >= 5 THEN 5 ELSE 0 END
   + CASE WHEN loc >= 1000 THEN 20 WHEN loc >= 500 THEN 10 WHEN loc >= 200 THEN 5 ELSE 0 END
   + CASE WHEN severity_weighted_score >= 20 THEN 25 WHEN severity_weighted_score >= 10 THEN 15
     WHEN severity_weighted_score >= 5 THEN 8 ELSE 0 END
   + CASE WHEN comment_ratio < 0.05 THEN 15 WHEN comment_ratio < 0.1 THEN 8 ELSE 0 END
   + CASE WHEN max_nesting_depth >= 5 THEN 15 WHEN max_nesting_depth >= 3 THEN 8 ELSE 0 END AS p,
   least(cyclomatic_complexity_avg / 30 * 0.4::DOUBLE + (1 - comment_ratio) * 0.3::DOUBLE
     + avg_function_length / 100 * 0.3::DOUBLE, 1.0::DOUBLE) AS m,
   list_filter([CASE WHEN cyclomatic_complexity_avg >= 10 THEN 'High cyclomatic complexity' END,
     CASE WHEN loc >= 500 THEN 'Large file size' END,
     CASE WHEN severity_weighted_score >= 10 THEN 'High-severity findings detected' END,
     CASE WHEN comment_ratio < 0.08 THEN 'Low documentation/comment ratio' END,
     CASE WHEN max_nesting_depth >= 4 THEN 'Deep code nesting' END,
     CASE WHEN avg_function_length >= 50 THEN 'Long function bodies' END,
     CASE WHEN num_imports >= 20 THEN 'High number of dependencies' END], lambda x: x IS NOT NULL)[1:5] AS f
  FROM features), final AS (SELECT *, CAST(format('{:.3f}', m) AS DOUBLE) AS mr FROM points)
 SELECT report_id, p / 100 AS defect_probability, mr AS maintenance_risk,
   CASE WHEN p >= 65 THEN 'HIGH' WHEN p >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS review_priority,
   p >= 50 OR mr >= 0.6 AS human_review_recommended,
   CASE WHEN len(f) = 0 THEN 'Metrics within acceptable ranges' ELSE array_to_string(f, '; ') END AS top_risk_factors,
   'heuristic_fallback' AS model_used FROM final"""

_LANGUAGE_SQL = (
    "CASE WHEN regexp_matches(path, '(?i)\\.py$') THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' "
    "WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.cpp' THEN 'cpp' END"
)
# RE2 has neither look-behind nor back-references: the same conditions spelled otherwise
_RE2 = {
    r"(?<![\w.])": r"(?:^|[^\w.])", r"(?<![\w.$])": r"(?:^|[^\w.$])", r"(?<![\w.>])": r"(?:^|[^\w.>])",
    r"=(?!=)": r"=(?:$|[^=])",
}


def _re2(pattern: str) -> str:
    for java, other in _RE2.items():
        pattern = pattern.replace(java, other)
    return pattern.replace("'", "''")


def _rules_sql() -> str:
    cases = []
    for rule_id, language, severity, pattern, _ in rulepack.RULES:
        if rule_id in rulepack.TWO_LINE:
            hit = (
                "regexp_extract(line, '(\\w+)\\s*=\\s*(?:\\([^)]*\\)\\s*)?malloc\\([^;]*\\);\\s*$', 1) <> '' AND "
                "regexp_extract(line, '(\\w+)\\s*=\\s*(?:\\([^)]*\\)\\s*)?malloc\\([^;]*\\);\\s*$', 1) = "
                "regexp_extract(next_line, '^\\s*\\*(\\w+)\\s*;', 1)"
            )
        else:
            hit = f"regexp_matches(line, '{_re2(pattern)}')"
        cases.append(
            f"CASE WHEN language = '{language}' AND {hit} THEN "
            f"struct_pack(rule_id := '{rule_id}', severity := '{severity}') END"
        )
    return (
        cte("source_files") + f""", {_LINES_SQL}, typed AS (SELECT *, {_LANGUAGE_SQL} AS language,
        lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS next_line FROM lines),
        hits AS (SELECT report_id, path AS file, no AS line_start, line AS lines,
          unnest(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS rule FROM typed) """
    )


def _files(spark, d):
    return view(spark, d, "source_files").drop("doc_id")


def _rounded(df):
    return df.withColumns(
        {n: F.round(n, 6) for n in ("avg_function_length", "comment_ratio")}
    )


def _features(spark, d):
    return _rounded(
        metrics.extract_features(metrics.file_metrics(_files(spark, d)), view(spark, d, "findings"))
    )


def _risk(spark, d):
    return risk.heuristic_risk(_features(spark, d)).select(
        "report_id", "defect_probability", "maintenance_risk", "review_priority",
        "human_review_recommended", F.array_join("top_risk_factors", "; ").alias("top_risk_factors"),
        "model_used",
    )


def _packed(spark, d):
    parts = narratives.packed_files(_files(spark, d))
    return parts.select(
        "report_id", F.col("place.name").alias("path"), F.md5("text").alias("digest"), F.char_length("text").alias("chars")
    )


def _structure(spark, d):
    return metrics.structure_metrics(_files(spark, d)).drop("content", "complex_blocks").filter(
        "num_functions IS NOT NULL"
    )


def _report_metrics(spark, d):
    profiled = durable(metrics.profile_files(_files(spark, d)), "file-profiles")
    return _rounded(metrics.report_metrics(profiled, metrics.complexity_findings(profiled)))


QUERIES = {
    "admitted_source_files": (
        lambda s, d: corpus.admitted_source_files(_files(s, d)).select(
            "report_id", "path", paths.file_name(F.col("path")).alias("file_name")
        ),
        cte("source_files") + """SELECT report_id, path, regexp_extract(path, '[^/]+$') AS file_name FROM source_files
         WHERE path NOT LIKE 'node_modules/%' AND regexp_matches(lower(path), '\\.(py|js|ts|java|cpp|cc|cxx|h|hpp)$')""",
    ),
    "reports_without_files": (
        lambda s, d: validation.file_counts(
            view(s, d, "reports").select(F.col("id").alias("report_id")),
            corpus.admitted_source_files(_files(s, d)),
        ),
        cte("source_files", "reports") + """, n AS (SELECT report_id, count(*) AS n FROM source_files
         WHERE path NOT LIKE 'node_modules/%' AND regexp_matches(lower(path), '\\.(py|js|ts|java|cpp)$') GROUP BY ALL)
         SELECT id AS report_id, coalesce(n, 0) AS num_files, n IS NULL AS is_empty
         FROM reports LEFT JOIN n ON n.report_id = id""",
    ),
    "line_metrics": (
        lambda s, d: metrics.line_metrics(_files(s, d)),
        cte("source_files") + _LINE_COUNTS_SQL + "SELECT * FROM line_metrics",
    ),
    "structure_metrics": (
        _structure,
        cte("source_files") + f", {_LINES_SQL}" + _STRUCTURE_SQL + "SELECT * FROM structure",
    ),
    "complexity_findings": (
        lambda s, d: metrics.complexity_findings(metrics.profile_files(_files(s, d))).select(
            "report_id", "file", "line_start", "severity", "confidence", "title", "description", "id"
        ),
        cte("source_files") + f", {_LINES_SQL}" + _STRUCTURE_SQL + """
         SELECT report_id, path AS file, no AS line_start, CASE WHEN cc >= 25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
          CAST(95 AS BIGINT) AS confidence, format('High cyclomatic complexity in ''{}'' (CC={})', name, CAST(cc AS BIGINT)) AS title,
          format('Function ''{}'' has a cyclomatic complexity of {}. Values above 10 indicate complex, hard-to-test code. Values above 25 are considered very high risk.', name, CAST(cc AS BIGINT)) AS description,
          concat('complexity-', left(sha256(concat_ws('|', report_id, path, name, no)), 16)) AS id
         FROM blocks JOIN source_files USING (doc_id) WHERE is_function AND cc >= 15""",
    ),
    "report_metrics": (
        _report_metrics,
        _REPORT_SQL + """, own AS (SELECT report_id, count(*) AS n FROM blocks JOIN source_files USING (doc_id)
          WHERE is_function AND cc >= 15 GROUP BY report_id)
         SELECT m.*, coalesce(own.n, 0) AS num_static_findings FROM report_metrics m LEFT JOIN own USING (report_id)""",
    ),
    "risk_features": (_features, _FEATURES_SQL + "SELECT * FROM features"),
    "heuristic_risk": (_risk, RISK_SQL),
    "rule_hits": (
        lambda s, d: rules.rule_hits(_files(s, d)).drop("message"),
        _rules_sql() + "SELECT report_id, file, CAST(line_start AS BIGINT) AS line_start, lines, rule.rule_id AS rule_id, "
        "rule.severity AS severity FROM hits",
    ),
    "rule_findings": (
        lambda s, d: rules.scan_rules(_files(s, d)).select(
            "report_id", "file", "line_start", "line_end", "title", "severity", "category",
            "confidence", "code_snippet",
        ),
        _rules_sql() + """SELECT report_id, file, CAST(line_start AS BIGINT) AS line_start, CAST(NULL AS BIGINT) AS line_end,
         concat('[Semgrep] ', rule.rule_id) AS title,
         CASE rule.severity WHEN 'ERROR' THEN 'HIGH' WHEN 'WARNING' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         CASE WHEN regexp_matches(rule.rule_id, 'eval|security|sql|secret|password|exec|format') THEN 'Security'
          WHEN regexp_matches(rule.rule_id, 'check|malloc|bug') THEN 'Bug' ELSE 'Quality' END AS category,
         CAST(80 AS BIGINT) AS confidence, nullif(trim(lines, concat(' ', chr(9))), '') AS code_snippet FROM hits""",
    ),
    "packed_files": (
        _packed,
        cte("source_files") + """, t AS (SELECT report_id, path, concat(CASE WHEN path = min(path) OVER (PARTITION BY report_id) THEN ''
           ELSE concat(chr(10), chr(10)) END, 'FILE: ', path, chr(10), '```', chr(10), content, chr(10), '```') AS text FROM source_files)
         SELECT report_id, path, md5(text) AS digest, CAST(length(text) AS INT) AS chars FROM t""",
    ),
}
