"""Registered queries over agent responses, scanner output, uploads and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill.functions import text
from findmill.functions.labels import rule_category
from findmill.plans.views import cte, view
from findmill.sources import defects, files, responses, scanner

_SPACE = "concat(' ', chr(9), chr(10), chr(13))"

_RESPONSES_SQL = cte("responses") + r""", blocks AS (SELECT report_id, response_no, agent, default_category,
   unnest(b) AS block, generate_subscripts(b, 1) - 1 AS block_no FROM (
    SELECT *, regexp_extract_all(text, '(?is)```json\s*(.*?)\s*```', 1) AS b FROM responses)),
 parsed AS (SELECT *, CASE WHEN json_valid(block) THEN block::JSON END AS j FROM blocks),
 listed AS (SELECT *, CASE json_type(j) WHEN 'ARRAY' THEN from_json(j, '["JSON"]') WHEN 'OBJECT' THEN [j] ELSE [] END AS xs FROM parsed),
 items AS (SELECT * FROM (SELECT report_id, response_no, agent, default_category, block_no, unnest(xs) AS x,
   generate_subscripts(xs, 1) - 1 AS item_no FROM listed) WHERE json_type(x) = 'OBJECT'),
 fields AS (SELECT *, json_type(x, '$.confidence') AS ck, x->>'$.confidence' AS c, json_type(x, '$.line_start') AS lk,
   x->>'$.line_start' AS l, x->>'$.severity' AS sv FROM items)
 SELECT report_id, concat_ws('.', lpad(CAST(response_no AS VARCHAR), 19, '0'), lpad(CAST(block_no AS VARCHAR), 19, '0'),
   lpad(CAST(item_no AS VARCHAR), 19, '0')) AS ord,
  coalesce(nullif(trim(x->>'$.id'), ''), sha256(concat_ws('|', report_id, agent, response_no, block_no, item_no))) AS id,
  agent, coalesce(trim(x->>'$.category'), default_category) AS category,
  CASE WHEN upper(sv) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(sv) ELSE 'MEDIUM' END AS severity,
  CAST(CASE WHEN ck IS NULL THEN 60 WHEN ck = 'NULL' THEN 50 WHEN ck = 'BOOLEAN' THEN CASE c WHEN 'true' THEN 1 ELSE 0 END
   WHEN ck = 'VARCHAR' AND NOT regexp_full_match(c, '\s*[+-]?\d+\s*') THEN 50
   WHEN ck IN ('VARCHAR','UBIGINT','BIGINT','DOUBLE') THEN least(greatest(trunc(CAST(c AS DOUBLE)), 0), 100) ELSE 50 END AS BIGINT) AS confidence,
  'ai_detected' AS source, nullif(trim(x->>'$.file'), '') AS file,
  CAST(CASE WHEN regexp_full_match(l, '\s*[+-]?\d+\s*') AND CAST(l AS BIGINT) > 0 THEN CAST(l AS BIGINT) END AS BIGINT) AS line_start,
  coalesce(trim(x->>'$.title'), 'Untitled finding') AS title,
  coalesce(trim(x->>'$.description'), 'No description provided.') AS description,
  coalesce(trim(x->>'$.impact'), 'Unknown impact.') AS impact,
  coalesce(trim(x->>'$.recommendation'), 'Review this code.') AS recommendation FROM fields"""

_CATEGORY_SQL = """CASE WHEN regexp_matches(lower({0}),
  'eval|security|sql|injection|xss|secret|password|passwd|crypto|auth|command|exec|path|traversal|overflow|format|cwe|rce|deserializ')
  THEN 'Security' WHEN regexp_matches(lower({0}), 'perf|performance|n\\+1|loop|cache') THEN 'Performance'
  WHEN regexp_matches(lower({0}), 'null|nullptr|error|exception|crash|bug|check|return|malloc') THEN 'Bug' ELSE 'Quality' END"""

_SCANS_SQL = cte("scans") + r""", docs AS (SELECT *, CASE WHEN json_valid(json) THEN json::JSON END AS j FROM scans),
 listed AS (SELECT *, CASE WHEN json_type(j, '$.results') = 'ARRAY' THEN from_json(json_extract(j, '$.results'), '["JSON"]') ELSE [] END AS xs FROM docs),
 items AS (SELECT * FROM (SELECT report_id, document_no, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS item_no FROM listed)
  WHERE json_type(x) = 'OBJECT'),
 flat AS (SELECT *, coalesce(x->>'$.check_id', 'unknown-rule') AS rule_id, coalesce(x->>'$.path', 'unknown') AS path,
  CAST(x->>'$.start.line' AS BIGINT) AS s, CAST(x->>'$.end.line' AS BIGINT) AS e, x->>'$.extra.lines' AS lines,
  upper(coalesce(x->>'$.extra.severity', 'INFO')) AS sv FROM items)
 SELECT report_id, concat_ws('.', lpad(CAST(document_no AS VARCHAR), 19, '0'), lpad(CAST(item_no AS VARCHAR), 19, '0')) AS ord, 'Static Analysis (Semgrep)' AS agent,
  """ + _CATEGORY_SQL.format("rule_id") + r""" AS category,
  CASE sv WHEN 'ERROR' THEN 'HIGH' WHEN 'WARNING' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(80 AS BIGINT) AS confidence,
  'static_analysis' AS source,
  CASE WHEN path LIKE '/tmp/repo/%' THEN replace(regexp_replace(substr(path, 11), '^/+', ''), '/./', '/')
   ELSE regexp_extract(path, '[^/]+$') END AS file,
  s AS line_start, nullif(e, s) AS line_end, concat('[Semgrep] ', rule_id) AS title,
  coalesce(x->>'$.extra.message', rule_id) AS description, concat('Detected by Semgrep rule: ', rule_id) AS impact,
  nullif(trim(lines), '') AS code_snippet FROM flat"""

_ISSUES_SQL = cte("issues") + """SELECT report_id, ord, CASE WHEN severity IN ('HIGH','MEDIUM','LOW') THEN severity ELSE 'MEDIUM' END AS severity,
 CAST(CASE confidence WHEN 'HIGH' THEN 85 WHEN 'MEDIUM' THEN 65 WHEN 'LOW' THEN 45 ELSE 60 END AS BIGINT) AS confidence,
 'Security' AS category, nullif(lineno, 0) AS line_start, nullif(lineno, 0) AS line_end, test AS title, text AS description,
 concat('Bandit test ID: ', test_id, '. CWE: ', coalesce(cwe, 'Unknown')) AS impact, nullif(trim(code), '') AS code_snippet FROM issues"""

_MEMBERS_SQL = cte("members") + r""", flagged AS (SELECT *,
   name LIKE '%/' OR name LIKE '.git/%' OR name LIKE '%node_modules/%' AS skipped,
   name LIKE '%../../../../../../etc/passwd' AS climbs FROM members),
 kept AS (SELECT *, NOT skipped AND climbs AS unsafe FROM flagged),
 summed AS (SELECT *, CAST(sum(CASE WHEN skipped OR unsafe THEN 0 ELSE size END) OVER (PARTITION BY archive_id ORDER BY pos
   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM kept),
 judged AS (SELECT *, NOT skipped AND NOT unsafe AND running_bytes > 104857600 AS too_large FROM summed) """

DEFECTS_SQL = cte("defect_rows") + """, n AS (SELECT TRY_CAST(coalesce(nullif(loc, ''), '0') AS DOUBLE) AS loc, CAST("v(g)" AS DOUBLE) AS vg,
  CAST(n AS DOUBLE) AS n, CAST("lOCode" AS DOUBLE) AS code, CAST("lOComment" AS DOUBLE) AS com, CAST("branchCount" AS DOUBLE) AS br,
  CAST("total_Op" AS DOUBLE) AS top, CAST("uniq_Op" AS DOUBLE) AS uop, defects FROM defect_rows)
 SELECT loc, top / 10 AS num_functions, uop / 5 AS num_classes, n / 50 AS num_imports, vg AS cyclomatic_complexity_avg,
  vg / 5 AS max_nesting_depth, loc / greatest(top / 10, 1) AS avg_function_length, CASE WHEN loc > 0 THEN com / loc ELSE 0 END AS comment_ratio,
  br / 10 AS num_static_findings, vg / 3 AS num_llm_findings, br * 2 + vg AS severity_weighted_score, code AS code_lines,
  CASE WHEN lower(defects) IN ('false', '0', 'f', '') THEN 0 ELSE 1 END AS label FROM n WHERE loc IS NOT NULL"""


def _responses(spark, d):
    return responses.parse_responses(view(spark, d, "responses")).drop(
        "line_end", "code_snippet", "suggested_fix", "merged_from"
    )


def _members(spark, d):
    return files.admit_members(view(spark, d, "members")).select(
        "archive_id", "pos", "skipped", "unsafe", "running_bytes", "too_large"
    )


QUERIES = {
    "json_blocks": (
        lambda s, d: responses.explode_blocks(view(s, d, "responses")).select(
            "report_id", "response_no", F.col("block_no").cast("bigint").alias("block_no"),
            F.md5("block").alias("digest"),
        ),
        _RESPONSES_SQL.split(",\n parsed")[0] + " SELECT report_id, response_no, block_no, md5(block) AS digest FROM blocks",
    ),
    "agent_findings": (_responses, _RESPONSES_SQL),
    "response_scores": (
        lambda s, d: view(s, d, "responses").select(
            "report_id", "response_no",
            text.score_by_pattern(F.col("text"), r"quality score:\s*(\d+)").alias("score"),
            text.score_by_pattern(F.col("text"), r"no such score:\s*(\d+)").alias("missing"),
        ),
        cte("responses") + """SELECT report_id, response_no,
         least(CAST(regexp_extract(text, '(?i)quality score:\\s*(\\d+)', 1) AS DOUBLE), 100) AS score,
         CAST(NULL AS DOUBLE) AS missing FROM responses""",
    ),
    "scanner_findings": (
        lambda s, d: scanner.parse_documents(view(s, d, "scans")).drop(
            "id", "recommendation", "suggested_fix", "merged_from"
        ),
        _SCANS_SQL,
    ),
    "linter_findings": (
        lambda s, d: scanner.linter_findings(view(s, d, "issues")).select(
            "report_id", "ord", "severity", "confidence", "category", "line_start", "line_end", "title",
            "description", "impact", "code_snippet",
        ),
        _ISSUES_SQL,
    ),
    "rule_categories": (
        lambda s, d: view(s, d, "issues").select("ord", rule_category(F.col("test")).alias("category")),
        cte("issues") + f"SELECT ord, {_CATEGORY_SQL.format('test')} AS category FROM issues",
    ),
    "admitted_uploads": (
        lambda s, d: files.admit_uploads(view(s, d, "uploads")),
        cte("uploads") + """SELECT path, length, CASE WHEN NOT regexp_matches(path, '(?i)[^/.][^/]*\\.zip$') THEN 'not_zip'
         WHEN length > 26214400 THEN 'too_large' ELSE 'ok' END AS verdict,
         regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]+$', '') AS display_name FROM uploads""",
    ),
    "archive_members": (
        _members,
        _MEMBERS_SQL + "SELECT archive_id, pos, skipped, unsafe, running_bytes, too_large FROM judged",
    ),
    "admitted_archives": (
        lambda s, d: files.admit_archives(view(s, d, "members")),
        _MEMBERS_SQL + """, fault AS (SELECT archive_id, min(pos) AS fault_pos FROM judged WHERE unsafe OR too_large GROUP BY ALL)
         SELECT j.archive_id, coalesce(max(CASE WHEN j.pos = f.fault_pos THEN CASE WHEN unsafe THEN 'unsafe_path' ELSE 'too_large' END END), 'ok') AS verdict,
          max(f.fault_pos) AS fault_pos, count(*) FILTER (WHERE NOT skipped AND NOT unsafe) AS members,
          CAST(coalesce(sum(CASE WHEN NOT skipped AND NOT unsafe THEN size END), 0) AS BIGINT) AS bytes
         FROM judged j LEFT JOIN fault f USING (archive_id) GROUP BY j.archive_id""",
    ),
    "defect_features": (
        lambda s, d: defects.defect_features(view(s, d, "defect_rows")),
        DEFECTS_SQL,
    ),
}
