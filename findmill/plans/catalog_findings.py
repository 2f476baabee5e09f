"""Registered queries over findings, each with the same result as plain SQL."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from findmill import vocab
from findmill.functions import labels, similarity
from findmill.operators import dedup, marts, metrics, ordering, validation
from findmill.plans.views import DESCRIPTIONS, TITLES, cte, stored, view

RANK_SQL = (
    "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 "
    "WHEN 'LOW' THEN 1 WHEN 'INFO' THEN 0 END"
)
_SHORT = ["report_id", "ord", "id", "severity", "category", "agent", "confidence"]
_COUNTS_SQL = ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_count" for s in vocab.SEVERITIES
)


def _broken(df):
    """The findings with some required values broken, by position."""
    k = F.col("ord")
    return df.withColumns(
        {
            "title": F.when(k % 37 == 0, F.lit(None)).otherwise(F.col("title")),
            "severity": F.when(k % 41 == 0, F.lower("severity")).otherwise(F.col("severity")),
            "confidence": F.when(k % 43 == 0, F.col("confidence") + 101).otherwise(F.col("confidence")),
            "source": F.when(k % 47 == 0, F.lit(None)).when(k % 53 == 0, "elsewhere").otherwise(F.col("source")),
        }
    )


_BROKEN_SQL = cte("findings") + """, broken AS (SELECT * REPLACE (
  CASE WHEN ord % 37 = 0 THEN NULL ELSE title END AS title,
  CASE WHEN ord % 41 = 0 THEN lower(severity) ELSE severity END AS severity,
  CASE WHEN ord % 43 = 0 THEN confidence + 101 ELSE confidence END AS confidence,
  CASE WHEN ord % 47 = 0 THEN NULL WHEN ord % 53 = 0 THEN 'elsewhere' ELSE source END AS source)
 FROM findings), judged AS (SELECT *, CASE
  WHEN title IS NULL THEN 'missing title'
  WHEN severity NOT IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN 'unknown severity'
  WHEN confidence NOT BETWEEN 0 AND 100 THEN 'confidence out of range'
  WHEN source NOT IN ('static_analysis','ai_detected','ai_suspected') THEN 'unknown source' END AS reject_reason
 FROM broken) """


def ratio_values(texts: list[str]) -> str:
    """VALUES rows (a, b, r) of the pairwise similarity of a fixed vocabulary."""
    low = sorted({t.lower() for t in texts})
    rows = [
        f"('{a}', '{b}', {SequenceMatcher(None, a, b).ratio()!r}::DOUBLE)" for a in low for b in low
    ]
    return "VALUES " + ", ".join(rows)


_DEDUP_SQL = (
    cte("findings").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", title_ratio(a, b, r) AS ({ratio_values(TITLES)}),
 text_ratio(a, b, r) AS ({ratio_values(DESCRIPTIONS)}),
 keyed AS (SELECT *, {RANK_SQL} AS sev, lower(category) AS cat, lower(title) AS t,
   lower(trim(file)) AS fk, line_start AS s,
   CASE WHEN line_start IS NOT NULL THEN coalesce(nullif(line_end, 0), line_start) END AS e,
   concat(CASE WHEN source = 'static_analysis' THEN '1.' ELSE '0.' END, lpad(CAST(ord AS VARCHAR), 19, '0')) AS seq FROM findings),
 corroborated AS (SELECT DISTINCT k.report_id, k.seq FROM keyed k
   JOIN keyed st ON st.report_id = k.report_id AND st.fk = k.fk AND st.source = 'static_analysis'
   JOIN title_ratio r ON r.a = k.t AND r.b = st.t AND r.r >= 0.65
   WHERE k.source <> 'static_analysis'),
 boosted AS (SELECT k.* REPLACE (CASE WHEN c.seq IS NULL THEN k.confidence ELSE least(k.confidence + 15, 100) END AS confidence),
   c.seq IS NOT NULL AS corroborated
   FROM keyed k LEFT JOIN corroborated c USING (report_id, seq)),
 near AS (SELECT map(list(concat(a, '|', b)), list(r)) AS m FROM title_ratio),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY report_id, cat ORDER BY seq) AS k,
   {{'seq': seq, 't': t, 'fk': fk, 's': s, 'e': e}} AS item FROM boosted),
 walk AS (
  SELECT report_id, cat, k, seq, [item] AS leaders, seq AS leader_seq FROM numbered WHERE k = 1
  UNION ALL
  SELECT report_id, cat, k, seq, CASE WHEN hit IS NULL THEN list_append(leaders, item) ELSE leaders END,
   coalesce(hit, seq)
  FROM (SELECT n.report_id, n.cat, n.k, n.seq, n.item, w.leaders,
    list_filter(w.leaders, lambda l:
      near.m[concat(l.t, '|', n.t)] >= 0.85
      OR (coalesce(l.fk = n.fk, false) AND (near.m[concat(l.t, '|', n.t)] >= 0.65
        OR coalesce(NOT (l.e < n.s OR n.e < l.s), false))))[1].seq AS hit
   FROM walk w JOIN numbered n ON n.report_id = w.report_id AND n.cat = w.cat AND n.k = w.k + 1, near)),
 labelled AS (SELECT b.*, w.leader_seq FROM boosted b JOIN walk w USING (report_id, seq)) """
)

_MERGED_SQL = _DEDUP_SQL + """, grouped AS (
 SELECT report_id, leader_seq, count(*) AS n, bool_or(source = 'static_analysis') AS st,
  arg_min(struct_pack(seq := seq, id := id, category := category, severity := severity, sev := sev,
    confidence := confidence, source := source, file := file, line_start := line_start, line_end := line_end,
    title := title, description := description, impact := impact, recommendation := recommendation,
    code_snippet := code_snippet, suggested_fix := suggested_fix),
    struct_pack(a := -sev, b := -confidence, c := seq)) AS p,
  arg_min(recommendation, struct_pack(a := -length(recommendation), b := seq)) FILTER (WHERE recommendation <> '') AS rec,
  arg_min(code_snippet, seq) FILTER (WHERE code_snippet <> '') AS snip,
  arg_min(suggested_fix, seq) FILTER (WHERE suggested_fix <> '') AS fix,
  string_agg(id, ',' ORDER BY seq) AS ids
 FROM labelled GROUP BY ALL),
 agents AS (SELECT report_id, leader_seq, string_agg(agent, ' + ' ORDER BY first_seq) AS agent FROM (
   SELECT report_id, leader_seq, agent, min(seq) AS first_seq FROM labelled GROUP BY ALL) GROUP BY ALL),
 others AS (SELECT l.report_id, l.leader_seq, l.seq, l.description AS d, g.p.description AS d0
   FROM labelled l JOIN grouped g USING (report_id, leader_seq) WHERE g.n > 1 AND l.seq <> g.p.seq),
 second AS (SELECT report_id, leader_seq, min(seq) AS s1, arg_min(d, seq) AS d1 FROM others
   JOIN text_ratio r ON r.a = lower(d) AND r.b = lower(d0) AND r.r < 0.65 GROUP BY ALL),
 third AS (SELECT o.report_id, o.leader_seq, arg_min(o.d, o.seq) AS d2 FROM others o
   JOIN second s ON s.report_id = o.report_id AND s.leader_seq = o.leader_seq AND o.seq > s.s1
   JOIN text_ratio r ON r.a = lower(o.d) AND r.b = lower(s.d1) AND r.r < 0.65 GROUP BY ALL),
 merged AS (SELECT g.report_id, g.leader_seq, g.p.seq AS primary_seq, g.n AS merged_count, g.p.id AS own_id, a.agent,
   g.p.category AS category, g.p.severity AS severity, g.p.sev AS sev,
   CAST(CASE WHEN n > 1 THEN least(g.p.confidence + (n - 1) * 10 + CASE WHEN st THEN 15 ELSE 0 END, 100)
     ELSE g.p.confidence END AS BIGINT) AS confidence,
   CASE WHEN st THEN 'static_analysis' ELSE g.p.source END AS source,
   g.p.file AS file, g.p.line_start AS line_start, g.p.line_end AS line_end, g.p.title AS title,
   concat_ws(' | ', g.p.description, d1, d2) AS description, g.p.impact AS impact,
   CASE WHEN n > 1 THEN coalesce(rec, g.p.recommendation) ELSE g.p.recommendation END AS recommendation,
   CASE WHEN n > 1 THEN snip ELSE g.p.code_snippet END AS code_snippet,
   CASE WHEN n > 1 THEN fix ELSE g.p.suggested_fix END AS suggested_fix,
   CASE WHEN n > 1 THEN ids ELSE '' END AS merged_from
  FROM grouped g JOIN agents a USING (report_id, leader_seq)
  LEFT JOIN second USING (report_id, leader_seq) LEFT JOIN third USING (report_id, leader_seq))
 SELECT * EXCLUDE (own_id, sev), CASE WHEN own_id <> '' AND row_number() OVER (
   PARTITION BY report_id, own_id ORDER BY sev DESC, confidence DESC, leader_seq) = 1 THEN own_id
   ELSE sha256(concat_ws('|', report_id, own_id, leader_seq)) END AS id FROM merged"""


def _keyed(spark, d):
    findings = stored(spark, d, "findings").transform(validation.valid_findings)
    return dedup.with_keys(ordering.input_order(findings))


def _merged(spark, d):
    return dedup.deduplicate(stored(spark, d, "findings")).withColumn(
        "merged_from", F.array_join("merged_from", ",")
    )


def _counts(spark, d):
    return marts.severity_counts(view(spark, d, "findings"), view(spark, d, "reports"))


def _summaries(spark, d):
    timings = view(spark, d, "findings").groupBy("report_id", "agent").agg(
        (F.sum("confidence") / 2).alias("execution_time_seconds")
    ).filter("agent <> 'Bug Agent'")
    return marts.agent_summaries(view(spark, d, "findings"), timings)


QUERIES = {
    "filter_by_severity": (
        lambda s, d: marts.filter_findings(view(s, d, "findings"), severity="high").select(*_SHORT),
        cte("findings") + f"SELECT {', '.join(_SHORT)} FROM findings WHERE severity = 'HIGH'",
    ),
    "filter_by_category_and_agent": (
        lambda s, d: marts.filter_findings(
            view(s, d, "findings"), category="SEC_R%T", agent="static"
        ).select(*_SHORT),
        cte("findings") + f"SELECT {', '.join(_SHORT)} FROM findings "
        "WHERE category ILIKE '%SEC_R%T%' AND agent ILIKE '%static%'",
    ),
    "static_evidence": (
        lambda s, d: marts.static_evidence(view(s, d, "findings")).select(*_SHORT),
        cte("findings") + f"SELECT {', '.join(_SHORT)} FROM findings "
        "WHERE source = 'static_analysis' OR lower(agent) LIKE '%semgrep%'",
    ),
    "valid_findings": (
        lambda s, d: validation.valid_findings(_broken(view(s, d, "findings"))).select(*_SHORT, "source"),
        _BROKEN_SQL + f"SELECT {', '.join(_SHORT)}, coalesce(source, 'ai_detected') AS source "
        "FROM judged WHERE reject_reason IS NULL",
    ),
    "rejected_findings": (
        lambda s, d: validation.rejected_findings(_broken(view(s, d, "findings"))).select(
            "report_id", "ord", "reject_reason"
        ),
        _BROKEN_SQL + "SELECT report_id, ord, reject_reason FROM judged WHERE reject_reason IS NOT NULL",
    ),
    "severity_counts": (
        _counts,
        cte("findings", "reports") + f"SELECT r.id AS report_id, {_COUNTS_SQL}, count(f.ord) AS total "
        "FROM reports r LEFT JOIN findings f ON f.report_id = r.id GROUP BY r.id",
    ),
    "top_findings": (
        lambda s, d: ordering.top_findings(view(s, d, "findings")).select(
            "report_id", "rank", "ord", "severity", "confidence", "title"
        ),
        cte("findings") + f"""SELECT report_id, rank, ord, severity, confidence, title FROM (
          SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {RANK_SQL} DESC, confidence DESC, ord)
          AS rank FROM findings) WHERE rank <= 5""",
    ),
    "findings_in_order": (
        lambda s, d: marts.list_findings(view(s, d, "findings"), tie="ord").select(
            "report_id", "ord", "confidence", labels.severity_rank(F.col("severity")).alias("severity_rank"),
            labels.severity_class(F.col("severity")).alias("severity_class"),
        ),
        cte("findings") + f"SELECT report_id, ord, confidence, {RANK_SQL} AS severity_rank, "
        "lower(severity) AS severity_class FROM findings ORDER BY report_id, confidence DESC, ord",
    ),
    "agent_summaries": (
        _summaries,
        cte("findings") + """SELECT report_id, agent, count(*) AS finding_count,
          CAST(sum(CASE WHEN agent <> 'Bug Agent' THEN confidence END) AS DOUBLE) / 2 AS execution_time_seconds,
          'completed' AS status FROM findings GROUP BY ALL""",
    ),
    "finding_totals": (
        lambda s, d: metrics.finding_totals(view(s, d, "findings")),
        cte("findings") + """SELECT report_id, count(*) FILTER (WHERE source = 'static_analysis') AS num_static_findings,
          count(*) FILTER (WHERE source <> 'static_analysis') AS num_llm_findings,
          CAST(sum(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1
            ELSE 0 END) AS BIGINT) AS severity_weighted_score FROM findings GROUP BY ALL""",
    ),
    "union_of_sources": (
        lambda s, d: ordering.input_order(
            ordering.union_findings(
                marts.static_evidence(view(s, d, "findings")),
                marts.filter_findings(view(s, d, "findings"), severity="low"),
            )
        ).select("report_id", "id", "source", "ord", "seq"),
        cte("findings") + """, u AS (SELECT *, concat(repeat('0', 19), '.', lpad(CAST(ord AS VARCHAR), 19, '0')) AS o FROM findings
           WHERE source = 'static_analysis' OR lower(agent) LIKE '%semgrep%'
          UNION ALL SELECT *, concat(repeat('0', 18), '1.', lpad(CAST(ord AS VARCHAR), 19, '0')) AS o FROM findings WHERE severity = 'LOW')
         SELECT report_id, id, source, o AS ord,
           concat(CASE WHEN source = 'static_analysis' THEN '1.' ELSE '0.' END, o) AS seq FROM u""",
    ),
    "title_ratio": (
        lambda s, d: view(s, d, "findings").select(
            "report_id", "ord",
            similarity.title_ratio(F.col("title"), F.lit(TITLES[3])).alias("ratio"),
            similarity.title_ratio(F.lit(TITLES[6]), F.col("title")).alias("reversed_ratio"),
        ),
        cte("findings") + f""", r(a, b, r) AS ({ratio_values(TITLES)})
         SELECT report_id, ord, x.r AS ratio, y.r AS reversed_ratio FROM findings
         JOIN r x ON x.a = lower(title) AND x.b = '{TITLES[3].lower()}'
         JOIN r y ON y.b = lower(title) AND y.a = '{TITLES[6]}'""",
    ),
    "corroborated_findings": (
        lambda s, d: dedup.boost_corroborated(_keyed(s, d)).select(
            "report_id", "ord", "confidence", "corroborated"
        ),
        _DEDUP_SQL + "SELECT report_id, ord, CAST(confidence AS BIGINT) AS confidence, corroborated FROM boosted",
    ),
    "duplicate_groups": (
        lambda s, d: dedup.group_members(dedup.label_groups(_keyed(s, d))),
        _DEDUP_SQL + "SELECT report_id, leader_seq, seq, id, agent FROM labelled",
    ),
    "merged_findings": (_merged, _MERGED_SQL),
}
