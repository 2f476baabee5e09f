"""Registered queries over reports, their owners, exports, integrity and erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill import schemas, vocab
from findmill.operators import export, integrity, marts, narratives
from findmill.plans.catalog_findings import RANK_SQL
from findmill.plans.views import cte, view
from findmill.sources import sinks

TABLE_VIEWS = {
    "users": "users", "repositories": "repositories", "reports": "reports",
    "analysis_results": "analysis_results", "findings": "stored_findings", "ml_predictions": "ml_predictions",
}
_STAMP = "yyyy-MM-dd HH:mm:ss"


def tables(spark, d):
    return {name: view(spark, d, source) for name, source in TABLE_VIEWS.items()}


def _stamped(df, *columns):
    return df.withColumns({c: F.date_format(c, _STAMP) for c in columns})


def _sql_stamp(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column.split('.')[-1]}"


def _details(spark, d):
    t = tables(spark, d)
    df = marts.report_details(
        t["reports"], t["repositories"], t["analysis_results"], t["findings"], t["ml_predictions"], user_id=1
    )
    top = F.array_join(F.transform("top_issues", lambda i: i["finding_id"]), ",")
    return df.select(
        "report_id", "user_id", "repository_name", "overall_score", "num_findings", "review_priority",
        F.char_length("documentation_report").alias("documentation_chars"), top.alias("top_issues"),
    )


_DETAILS_SQL = cte("users", "repositories", "reports", "analysis_results", "ml_predictions", "stored_findings") + f"""
 , ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {RANK_SQL} DESC, confidence DESC, id) AS rk
   FROM stored_findings),
 tops AS (SELECT report_id, string_agg(finding_id, ',' ORDER BY rk) AS top_issues FROM ranked WHERE rk <= 5 GROUP BY ALL),
 n AS (SELECT report_id, count(*) AS n FROM stored_findings GROUP BY ALL)
 SELECT r.id AS report_id, o.user_id, o.repository_name, r.overall_score, coalesce(n.n, 0) AS num_findings,
  p.review_priority, CAST(length(a.documentation_report) AS INT) AS documentation_chars, tops.top_issues
 FROM reports r JOIN repositories o ON o.id = r.repository_id AND o.user_id = 1
 LEFT JOIN analysis_results a ON a.report_id = r.id LEFT JOIN ml_predictions p ON p.report_id = r.id
 LEFT JOIN n ON n.report_id = r.id LEFT JOIN tops ON tops.report_id = r.id"""


def _parts(parts):
    """A document's parts with their place, one column for each member that the parts use."""
    return parts.select("report_id", "place.section", "place.major", "place.minor", "place.page", "text")


def _json(spark, d):
    t = tables(spark, d)
    parts = export.json_parts(t["reports"], t["findings"], t["ml_predictions"])
    return _parts(parts)


_JSON_SQL = cte("reports", "stored_findings", "ml_predictions") + """, f AS (SELECT report_id, -confidence AS minor, id // 1000 AS page,
   string_agg(to_json({'id': finding_id, 'agent': agent, 'category': category, 'severity': severity,
    'confidence': confidence, 'source': source, 'file': file, 'line_start': line_start, 'line_end': line_end,
    'title': title, 'description': description, 'impact': impact, 'recommendation': recommendation,
    'code_snippet': code_snippet, 'suggested_fix': suggested_fix}), ',' ORDER BY id) AS items
   FROM stored_findings WHERE report_id IN (SELECT id FROM reports) GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY minor, page) AS k FROM f),
 p AS (SELECT report_id, to_json({'defect_probability': defect_probability, 'maintenance_risk': maintenance_risk,
   'review_priority': review_priority, 'human_review_recommended': human_review_recommended,
   'top_risk_factors': CASE WHEN json_valid(top_risk_factors) THEN from_json(top_risk_factors, '["VARCHAR"]') ELSE [] END,
   'model_used': model_used, 'disclaimer': disclaimer}) AS j FROM ml_predictions)
 SELECT r.id AS report_id, 0 AS section, 0 AS major, 0 AS minor, 0 AS page, concat(
  left(to_json({'report_id': r.id, 'repository_id': r.repository_id,
   'created_at': strftime(r.created_at, '%Y-%m-%dT%H:%M:%S'), 'overall_score': r.overall_score,
   'scores': {'overall': r.overall_score, 'quality': r.quality_score, 'security': r.security_score,
     'performance': r.performance_score, 'maintainability': r.maintainability_score, 'testing': r.testing_score},
   'finding_counts': {'critical': r.critical_count, 'high': r.high_count, 'medium': r.medium_count, 'low': r.low_count,
     'info': r.info_count, 'total': r.critical_count + r.high_count + r.medium_count + r.low_count + r.info_count}}), -1),
  ',"findings":[') AS text FROM reports r
 UNION ALL SELECT report_id, 1, 0, minor, page, concat(CASE WHEN k = 1 THEN '' ELSE ',' END, items) FROM n
 UNION ALL SELECT r.id, 2, 0, 0, 0, concat('],"ml_prediction":', coalesce(p.j, 'null'),
  ',"final_narrative":', to_json(r.summary), '}')
 FROM reports r LEFT JOIN p ON p.report_id = r.id"""


def _markdown(spark, d):
    t = tables(spark, d)
    parts = export.markdown_parts(t["reports"], t["findings"], t["ml_predictions"])
    return _parts(parts)


_SCORE_LINES = ", ".join(
    f"concat('| {s.capitalize()} | ', format('{{:.0f}}', r.{s}_score), ' / 100 |')" for s in vocab.SCORES
)
_COUNT_LINES = ", ".join(
    f"concat('| {icon} {s.capitalize()} | ', r.{s.lower()}_count, ' |')" for s, icon in vocab.SEVERITY_BADGE.items()
)
_MARKDOWN_SQL = cte("reports", "stored_findings", "ml_predictions") + f""", f AS (SELECT report_id, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3
     WHEN 'INFO' THEN 4 ELSE 5 END AS major, -confidence AS minor, id // 1000 AS page,
  string_agg(concat(array_to_string(list_filter([
   concat('### ', CASE severity {' '.join(f"WHEN '{s}' THEN '{i}'" for s, i in vocab.SEVERITY_BADGE.items())} END,
     ' [', severity, '] ', title), '', concat('**Agent:** ', agent, '  '), concat('**Category:** ', category, '  '),
   concat('**Confidence:** ', confidence, '%  '),
   CASE WHEN file <> '' THEN concat('**Location:** `', file, '` (', CASE WHEN line_start <> 0
     THEN concat('Lines ', line_start, '–', coalesce(CAST(line_end AS VARCHAR), 'None')) ELSE 'unknown line' END, ')  ') END,
   '', concat('**Description:** ', description), '', concat('**Impact:** ', impact), '',
   concat('**Recommendation:** ', recommendation),
   CASE WHEN code_snippet <> '' THEN concat(chr(10), '**Code:**', chr(10), '```', chr(10), code_snippet, chr(10), '```') END,
   CASE WHEN suggested_fix <> '' THEN concat(chr(10), '**Suggested Fix (AI-generated):**', chr(10), '```', chr(10),
     suggested_fix, chr(10), '```') END, '', '---', ''], lambda x: x IS NOT NULL), chr(10)), chr(10)), ''
   ORDER BY id) AS items FROM stored_findings WHERE report_id IN (SELECT id FROM reports) GROUP BY ALL),
 p AS (SELECT report_id, concat(array_to_string(list_concat(['## 2. ML Code Risk Prediction', '',
   concat('> ⚠️ ', disclaimer), '', '| Metric | Value |', '|--------|-------|',
   concat('| Defect Probability | ', format('{{:.1f}}', defect_probability * 100), '% |'),
   concat('| Maintenance Risk | ', format('{{:.1f}}', maintenance_risk * 100), '% |'),
   concat('| Review Priority | ', review_priority, ' |'),
   concat('| Human Review Recommended | ', CASE WHEN human_review_recommended THEN '✅ Yes' ELSE '❌ No' END, ' |'),
   '', '**Top Risk Factors:**'],
   list_concat(list_transform(CASE WHEN json_valid(top_risk_factors) THEN from_json(top_risk_factors, '["VARCHAR"]') ELSE [] END,
     lambda x: concat('- ', x)), ['', '---', ''])), chr(10)), chr(10)) AS text FROM ml_predictions)
 SELECT r.id AS report_id, 0 AS section, 0 AS major, 0 AS minor, 0 AS page, array_to_string(['# AI Code Review Report', '', concat('**Report ID:** ', r.id),
   concat('**Date:** ', strftime(r.created_at, '%Y-%m-%d %H:%M'), ' UTC'), '', '---', '', '## 1. Executive Summary', '',
   '| Metric | Score |', '|--------|-------|', {_SCORE_LINES}, '', '### Issue Counts', '', '| Severity | Count |',
   '|----------|-------|', {_COUNT_LINES}, '', '---', '', ''], chr(10)) AS text FROM reports r
 UNION ALL SELECT report_id, 1, 0, 0, 0, text FROM p WHERE report_id IN (SELECT id FROM reports)
 UNION ALL SELECT id, 2, 0, 0, 0, concat('## 3. Findings', chr(10), chr(10)) FROM reports
 UNION ALL SELECT report_id, 3, major, minor, page, items FROM f
 UNION ALL SELECT id, 4, 0, 0, 0, concat('## 4. Full Analysis', chr(10), chr(10), summary) FROM reports"""


def _violations_sql():
    parts = []
    for child, key, parent in schemas.FOREIGN_KEYS:
        parts.append(
            f"SELECT '{child}' AS table_name, 'orphan' AS rule, '{key}' AS column_name, CAST(id AS VARCHAR) AS key_value "
            f"FROM {TABLE_VIEWS[child]} WHERE {key} NOT IN (SELECT id FROM {TABLE_VIEWS[parent]})"
        )
    for table, column in schemas.UNIQUE_KEYS:
        parts.append(
            f"SELECT '{table}', 'duplicate', '{column}', CAST({column} AS VARCHAR) FROM {TABLE_VIEWS[table]} "
            f"GROUP BY {column} HAVING count(*) > 1"
        )
    for table, column, limit in schemas.TEXT_LIMITS:
        parts.append(
            f"SELECT '{table}', 'too_long', '{column}', CAST(id AS VARCHAR) FROM {TABLE_VIEWS[table]} "
            f"WHERE length({column}) > {limit}"
        )
    return cte(*TABLE_VIEWS.values()) + " UNION ALL ".join(parts)


def _erased(spark, d):
    """Rows left per table, and archives to purge, after two users are erased."""
    t = tables(spark, d)
    survivors, paths = integrity.erase(t, "users", t["users"].filter("id IN (1, 3)"))
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows_left")) for name, df in survivors.items()
    ]
    counts.append(paths.agg(F.lit("purged_archives").alias("table_name"), F.count("*").alias("rows_left")))
    out = counts[0]
    for df in counts[1:]:
        out = out.unionAll(df)
    return out


_ERASED_SQL = cte(*TABLE_VIEWS.values()) + """, u AS (SELECT id FROM users WHERE id IN (1, 3)),
 ro AS (SELECT id FROM repositories WHERE user_id IN (FROM u)),
 re AS (SELECT id FROM reports WHERE repository_id IN (FROM ro))
 SELECT 'users' AS table_name, count(*) AS rows_left FROM users WHERE id NOT IN (FROM u)
 UNION ALL SELECT 'repositories', count(*) FROM repositories WHERE id NOT IN (FROM ro)
 UNION ALL SELECT 'reports', count(*) FROM reports WHERE id NOT IN (FROM re)
 UNION ALL SELECT 'analysis_results', count(*) FROM analysis_results WHERE report_id NOT IN (FROM re)
 UNION ALL SELECT 'findings', count(*) FROM stored_findings WHERE report_id NOT IN (FROM re)
 UNION ALL SELECT 'ml_predictions', count(*) FROM ml_predictions WHERE report_id NOT IN (FROM re)
 UNION ALL SELECT 'purged_archives', count(*) FROM ro"""


def _review_rows(spark, d):
    reports = view(spark, d, "reports").drop(*[f"{s.lower()}_count" for s in vocab.SEVERITIES])
    sparse = reports.withColumn(
        "quality_score", F.when(F.col("id") % 3 > 0, F.col("quality_score"))
    ).withColumnRenamed("summary", "final_summary")
    return sparse.join(view(spark, d, "narratives").withColumnRenamed("report_id", "id").hint("merge"), "id")


def _stored_report(spark, d):
    reports, results = sinks.stored_reports(_review_rows(spark, d), view(spark, d, "findings"))
    joined = reports.join(results.drop("id").withColumnRenamed("report_id", "id").hint("merge"), "id")
    return _stamped(joined, "created_at").withColumn(
        "documentation_report", F.char_length("documentation_report")
    ).withColumn("refactoring_report", F.char_length("refactoring_report"))


_SCORE_LIST = ", ".join(f"r.{s}_score" for s in vocab.SCORES if s != "quality")
_COUNT_LIST = ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_count" for s in vocab.SEVERITIES
)
_ZERO_LIST = ", ".join(f"coalesce({s.lower()}_count, 0) AS {s.lower()}_count" for s in vocab.SEVERITIES)


def _predictions(spark, d):
    df = marts.report_predictions(view(spark, d, "reports"), view(spark, d, "ml_predictions"))
    return df.withColumns(
        {
            "top_risk_factors": F.array_join("top_risk_factors", ","),
            "shap_values": F.element_at("shap_values", "loc"),
        }
    )


def _stored_predictions(spark, d):
    raw = view(spark, d, "ml_predictions").drop("disclaimer", "shap_values").withColumns(
        {
            "review_priority": F.when(F.col("id") % 5 > 0, F.col("review_priority")),
            "top_risk_factors": F.from_json("top_risk_factors", "array<string>"),
        }
    )
    return sinks.stored_predictions(raw)


def _fallback(spark, d):
    packed = narratives.packed_reports(narratives.fallback_summary(view(spark, d, "narratives")))
    return narratives.final_scores(packed).select(
        "report_id", "packed", "final_summary", *[f"{s}_score" for s in vocab.SCORES]
    )


_NARRATIVE_SQL = cte("narratives") + """, found AS (SELECT *,
   least(coalesce(CAST(nullif(regexp_extract(quality_report, '(?i)Quality Score[:\\s]+(\\d{1,3})', 1), '') AS INT), 0), 100) AS q,
   least(coalesce(CAST(nullif(regexp_extract(security_report, '(?i)Security Score[:\\s]+(\\d{1,3})', 1), '') AS INT), 0), 100) AS s,
   least(coalesce(CAST(nullif(regexp_extract(performance_report, '(?i)Performance Score[:\\s]+(\\d{1,3})', 1), '') AS INT), 0), 100) AS p
  FROM narratives), scored AS (SELECT *, CAST(coalesce(format('{:.1f}', list_avg(list_filter([q, s, p], lambda x: x > 0))), '75.0') AS DOUBLE) AS o
  FROM found), texts AS (SELECT *, concat(
   CASE WHEN length(a) > 90000 THEN concat(left(a, 90000), chr(10), chr(10), '[... report truncated for length ...]') ELSE a END) AS packed
  FROM (SELECT *, array_to_string(list_transform([
     ['Code Quality Report', quality_report], ['Bug Detection Report', bug_report], ['Security Report', security_report],
     ['Performance Report', performance_report], ['Refactoring Report', refactoring_report],
     ['Documentation Report', documentation_report]], lambda x: concat('## ', x[1], chr(10),
       CASE WHEN length(coalesce(x[2], 'No report available.')) > 25000
        THEN concat(left(x[2], 25000), chr(10), chr(10), '[... report truncated for length ...]')
        ELSE coalesce(x[2], 'No report available.') END)), concat(chr(10), chr(10))) AS a FROM scored)),
 final AS (SELECT *, array_to_string(list_concat([concat('# AI Code Review Report', chr(10)),
   concat('## 1. Overall Score: ', CAST(floor(o) AS INT), chr(10)), concat('## 2. Score Breakdown', chr(10)),
   concat('- Quality Score: ', CAST(floor(CASE WHEN q = 0 THEN o ELSE q END) AS INT), chr(10)),
   concat('- Security Score: ', CAST(floor(CASE WHEN s = 0 THEN o ELSE s END) AS INT), chr(10)),
   concat('- Performance Score: ', CAST(floor(CASE WHEN p = 0 THEN o ELSE p END) AS INT), chr(10)),
   concat('- Maintainability Score: ', CAST(floor(CASE WHEN q = 0 THEN o ELSE q END) AS INT), chr(10)),
   concat('- Testing Score: ', CAST(floor(o) AS INT), chr(10)),
   concat(chr(10), '## 3. Executive Summary', chr(10)),
   concat('All specialized code review agents completed their analysis. The consolidated report below summarizes findings across code quality, security, performance, and maintainability.', chr(10))],
   list_transform(list_filter([
     ['Code Quality', quality_report], ['Bug Detection', bug_report], ['Security', security_report],
     ['Performance', performance_report], ['Refactoring', refactoring_report], ['Documentation', documentation_report]],
     lambda x: x[2] <> ''), lambda x: concat(chr(10), '## ', x[1], chr(10), CASE WHEN length(x[2]) > 4000
       THEN concat(left(x[2], 4000), chr(10), chr(10), '[... report truncated for length ...]') ELSE x[2] END, chr(10)))),
   chr(10)) AS final_summary FROM texts)
 SELECT report_id, packed, final_summary, CAST(floor(o) AS DOUBLE) AS overall_score,
  floor(CASE WHEN q = 0 THEN o ELSE q END)::DOUBLE AS quality_score, floor(CASE WHEN s = 0 THEN o ELSE s END)::DOUBLE AS security_score,
  floor(CASE WHEN p = 0 THEN o ELSE p END)::DOUBLE AS performance_score,
  floor(CASE WHEN q = 0 THEN o ELSE q END)::DOUBLE AS maintainability_score, floor(o)::DOUBLE AS testing_score FROM final"""

_SCORES_SQL = cte("reports") + """, s AS (SELECT id AS report_id, summary,
   least(coalesce(CAST(nullif(regexp_extract(summary, '(?i)Security Score[:\\s]+(\\d{1,3})', 1), '') AS DOUBLE), 0), 100) AS sec FROM reports)
 SELECT report_id, sec AS overall_score, 0.0::DOUBLE AS quality_score, sec AS security_score, 0.0::DOUBLE AS performance_score,
  0.0::DOUBLE AS maintainability_score, 0.0::DOUBLE AS testing_score FROM s"""

QUERIES = {
    "user_reports": (
        lambda s, d: _stamped(
            marts.user_reports(view(s, d, "reports"), view(s, d, "repositories"), user_id=2), "created_at"
        ).select("user_id", "id", "repository_id", "repository_name", "overall_score", "created_at"),
        cte("reports", "repositories") + f"""SELECT o.user_id, r.id, r.repository_id, o.repository_name, r.overall_score,
         {_sql_stamp('r.created_at')} FROM reports r JOIN repositories o ON o.id = r.repository_id AND o.user_id = 2""",
    ),
    "user_repositories": (
        lambda s, d: _stamped(marts.user_repositories(view(s, d, "repositories")), "uploaded_at"),
        cte("repositories") + f"SELECT user_id, id, repository_name, {_sql_stamp('uploaded_at')} FROM repositories",
    ),
    "public_users": (
        lambda s, d: _stamped(marts.public_users(view(s, d, "users")), "created_at"),
        cte("users") + f"SELECT id, name, email, {_sql_stamp('created_at')} FROM users",
    ),
    "owned_findings": (
        lambda s, d: marts.owned_findings(
            view(s, d, "stored_findings"), view(s, d, "reports"), view(s, d, "repositories"), user_id=4
        ).select("report_id", "finding_id", "title", "confidence"),
        cte("stored_findings", "reports", "repositories") + """SELECT report_id, finding_id, title, confidence
         FROM stored_findings WHERE report_id IN (SELECT r.id FROM reports r JOIN repositories o
          ON o.id = r.repository_id WHERE o.user_id = 4)""",
    ),
    "issue_totals": (
        lambda s, d: marts.issue_totals(view(s, d, "reports")),
        cte("reports") + """SELECT id AS report_id, critical_count + high_count + medium_count + low_count AS listed_total,
         critical_count + high_count + medium_count + low_count + info_count AS export_total,
         CASE WHEN overall_score >= 80 THEN 'great' WHEN overall_score >= 65 THEN 'good'
          WHEN overall_score >= 45 THEN 'warn' ELSE 'bad' END AS score_band FROM reports""",
    ),
    "dashboard": (
        lambda s, d: marts.dashboard(view(s, d, "reports"), view(s, d, "repositories"), view(s, d, "users")),
        cte("reports", "repositories", "users") + """SELECT u.id AS user_id, count(r.id) AS num_reports,
         coalesce(CAST(format('{:.1f}', avg(r.overall_score)) AS DOUBLE), 0.0::DOUBLE) AS avg_score,
         CAST(coalesce(sum(critical_count), 0) AS BIGINT) AS critical_total, CAST(coalesce(sum(high_count), 0) AS BIGINT) AS high_total
         FROM users u LEFT JOIN repositories o ON o.user_id = u.id LEFT JOIN reports r ON r.repository_id = o.id GROUP BY u.id""",
    ),
    "review_summaries": (
        lambda s, d: marts.review_summaries(
            view(s, d, "reports"), view(s, d, "findings"), view(s, d, "ml_predictions")
        ),
        cte("reports", "findings", "ml_predictions") + f""", n AS (SELECT report_id, count(*) AS total, {_COUNT_LIST}
          FROM findings GROUP BY report_id)
         SELECT r.id AS report_id, r.repository_id, r.overall_score, r.quality_score, r.security_score, r.performance_score,
          r.maintainability_score, r.testing_score, coalesce(n.total, 0) AS finding_count,
          coalesce(n.critical_count, 0) AS critical_count, coalesce(n.high_count, 0) AS high_count,
          coalesce(n.medium_count, 0) AS medium_count, coalesce(n.low_count, 0) AS low_count,
          p.review_priority AS ml_risk_priority, p.defect_probability AS ml_defect_probability, p.human_review_recommended
         FROM reports r LEFT JOIN n ON n.report_id = r.id LEFT JOIN ml_predictions p ON p.report_id = r.id""",
    ),
    "report_predictions": (
        _predictions,
        cte("reports", "ml_predictions") + """SELECT r.id AS report_id, defect_probability, maintenance_risk, review_priority,
         human_review_recommended, CASE WHEN p.id IS NOT NULL THEN CASE WHEN json_valid(top_risk_factors)
          THEN array_to_string(from_json(top_risk_factors, '["VARCHAR"]'), ',') ELSE '' END END AS top_risk_factors,
         CASE WHEN shap_values = '{"loc":0.5}' THEN 0.5::DOUBLE END AS shap_values, model_version, model_used, disclaimer
         FROM reports r LEFT JOIN ml_predictions p ON p.report_id = r.id""",
    ),
    "report_details": (_details, _DETAILS_SQL),
    "exported_findings": (
        lambda s, d: export.exported_findings(view(s, d, "stored_findings")),
        cte("stored_findings") + "SELECT * EXCLUDE (id, finding_id), finding_id AS id FROM stored_findings",
    ),
    "export_json": (_json, _JSON_SQL),
    "export_markdown": (_markdown, _MARKDOWN_SQL),
    "stored_findings": (
        lambda s, d: sinks.stored_findings(
            view(s, d, "findings").withColumn(
                "merged_from",
                F.when(F.col("ord") % 3 == 0, F.array("id", "title")).otherwise(F.array().cast("array<string>")),
            )
        ).select("report_id", "finding_id", "merged_from"),
        cte("findings") + """SELECT report_id, id AS finding_id,
         CASE WHEN ord % 3 = 0 THEN CAST(to_json([id, title]) AS VARCHAR) END AS merged_from FROM findings""",
    ),
    "stored_predictions": (
        _stored_predictions,
        cte("ml_predictions") + """SELECT id, report_id, defect_probability, maintenance_risk,
         CASE WHEN id % 5 > 0 THEN review_priority ELSE 'UNKNOWN' END AS review_priority, human_review_recommended,
         CASE WHEN json_valid(top_risk_factors) THEN top_risk_factors ELSE '[]' END AS top_risk_factors,
         '{}' AS shap_values, model_version, model_used, '' AS disclaimer FROM ml_predictions""",
    ),
    "stored_reports": (
        _stored_report,
        cte("reports", "narratives", "findings") + f""", n AS (SELECT report_id, {_COUNT_LIST} FROM findings GROUP BY ALL)
         SELECT r.id, r.repository_id, r.summary, {_sql_stamp('r.created_at')}, {_SCORE_LIST},
          CASE WHEN r.id % 3 > 0 THEN r.quality_score ELSE 0.0 END AS quality_score, {_ZERO_LIST.replace('coalesce(', 'coalesce(n.')},
          v.quality_report, v.bug_report, v.security_report, v.performance_report,
          coalesce(length(v.refactoring_report), 0) AS refactoring_report, length(v.documentation_report) AS documentation_report
         FROM reports r JOIN narratives v ON v.report_id = r.id LEFT JOIN n ON n.report_id = r.id""",
    ),
    "violations": (lambda s, d: integrity.violations(tables(s, d)), _violations_sql()),
    "erasure": (_erased, _ERASED_SQL),
    "final_scores": (
        lambda s, d: narratives.final_scores(
            view(s, d, "reports").select(F.col("id").alias("report_id"), F.col("summary").alias("final_summary"))
        ).drop("final_summary"),
        _SCORES_SQL,
    ),
    "packed_and_fallback_reports": (_fallback, _NARRATIVE_SQL),
}
