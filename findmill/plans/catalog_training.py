"""Registered queries over labelled rows: splits, metrics, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill import vocab
from findmill.operators import evaluation, metrics, risk, training, trees
from findmill.plans.catalog_sources import DEFECTS_SQL
from findmill.plans.views import cte, read, view
from findmill.session import durable
from findmill.sources import defects

_SPLIT = """CASE WHEN CAST(concat('0x', left(md5(concat_ws('|', label, doc_id)), 6)) AS BIGINT) % 100 < 60 THEN 'train'
 WHEN CAST(concat('0x', left(md5(concat_ws('|', label, doc_id)), 6)) AS BIGINT) % 100 < 80 THEN 'validation' ELSE 'test' END"""
_SPLIT_SQL = cte("scored") + f""", split AS (SELECT *, {_SPLIT} AS split FROM scored) """
_CURVE = """, steps AS (SELECT probability, sum(label) AS pos, sum(1 - label) AS neg FROM {0} GROUP BY ALL),
 curve AS (SELECT *, sum(pos) OVER w AS ap, sum(neg) OVER w AS an FROM steps
  WINDOW w AS (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING)),
 ranking AS (SELECT sum(neg * (ap - pos + pos / 2)) / (max(ap) * max(an)) AS roc_auc,
  sum(pos * (ap / (ap + an))) / max(ap) AS pr_auc FROM curve) """
_CONFUSION = """, classes AS (SELECT c AS class, count(*) FILTER (WHERE label = c AND prediction = c) AS hits,
  count(*) FILTER (WHERE prediction = c) AS said, count(*) FILTER (WHERE label = c) AS support
  FROM {0}, (VALUES (0), (1)) v(c) GROUP BY c),
 report AS (SELECT class, coalesce(hits / nullif(said, 0), 0)::DOUBLE AS precision, coalesce(hits / nullif(support, 0), 0)::DOUBLE AS recall,
  coalesce(2 * hits / nullif(said + support, 0), 0)::DOUBLE AS f1, support FROM classes) """


def split_rows(spark, d):
    return training.with_split(view(spark, d, "scored"), "doc_id")


def _features_of_documents(spark, d):
    """Labelled source files, each a report of its own, as training rows: their metrics, and the findings of that number.

    Labels are joined before any text is profiled.
    """
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("report_id"), F.col("quality").alias("label"))
    files = view(spark, d, "source_files").select(F.col("doc_id").alias("report_id"), "path", "content")
    files = files.join(labels.select("report_id"), "report_id", "left_semi")
    features = metrics.extract_features(metrics.file_metrics(files), view(spark, d, "findings"))
    return training.with_split(features.join(labels, "report_id"), "report_id")


def _trained(spark, d):
    rows = durable(_features_of_documents(spark, d), "training-rows")
    return rows, training.train(rows)


def _model_scores(spark, d):
    rows, model = _trained(spark, d)
    return training.score(model, rows).select("report_id", "label", "split", "probability", "prediction")


def _model_evaluation(spark, d):
    rows, model = _trained(spark, d)
    return evaluation.evaluate(durable(training.score(model, rows), "scored-rows"))


_OWN_DISCLAIMER = (
    "Risk prediction is based on code metrics and quality labels of the documents. It indicates likelihood of issues, not certainty."
)


def _model_risk(spark, d):
    rows, model = _trained(spark, d)
    parts = training.contributions(model, rows, "report_id")
    return risk.model_risk(rows.join(parts, "report_id"), "boosted_trees_quality", _OWN_DISCLAIMER).select(
        "report_id", "defect_probability", "maintenance_risk", "review_priority",
        "human_review_recommended", F.array_join("top_risk_factors", "; ").alias("top_risk_factors"),
        F.size("shap_values").alias("num_contributions"), "model_used",
    )


# a small ensemble (tree, node, feature, threshold, low, high, value, weight) for all rows of the table of defects
_NODES = [
    (0, 0, "cyclomatic_complexity_avg", 10.0, 1, 2, None, 1.0),
    (0, 1, "loc", 50.0, 3, 4, None, 1.0),
    (0, 2, "comment_ratio", 0.05, 5, 6, None, 1.0),
    (0, 3, None, None, None, None, -0.75, 1.0),
    (0, 4, None, None, None, None, -0.25, 1.0),
    (0, 5, None, None, None, None, 0.75, 1.0),
    (0, 6, None, None, None, None, 0.125, 1.0),
    (1, 0, "severity_weighted_score", 20.0, 1, 2, None, 0.5),
    (1, 1, None, None, None, None, -0.5, 0.5),
    (1, 2, "num_functions", 4.0, 3, 4, None, 0.5),
    (1, 3, "code_lines", 60.0, 5, 6, None, 0.5),
    (1, 4, None, None, None, None, 0.5, 0.5),
    (1, 5, None, None, None, None, 0.25, 0.5),
    (1, 6, None, None, None, None, 1.0, 0.5),
    (2, 0, "num_llm_findings", 8.0, 1, 2, None, 0.25),
    (2, 1, "avg_function_length", 30.0, 3, 4, None, 0.25),
    (2, 2, "max_nesting_depth", 6.0, 5, 6, None, 0.25),
    (2, 3, None, None, None, None, -0.25, 0.25),
    (2, 4, None, None, None, None, 0.5, 0.25),
    (2, 5, None, None, None, None, 0.25, 0.25),
    (2, 6, None, None, None, None, 0.75, 0.25),
]
_USUAL = dict.fromkeys(vocab.FEATURES, 5.0) | {"loc": 60.0, "comment_ratio": 0.1, "severity_weighted_score": 25.0, "code_lines": 75.0}


def _reached(variants):
    """SQL: where each row, in each of its variants, ends in each tree, by one join a level."""
    cells = ", ".join("(" + ", ".join("NULL" if c is None else repr(c) for c in node) + ")" for node in _NODES)
    usual = " ".join(f"WHEN '{n}' THEN {v}" for n, v in _USUAL.items())
    sql = f"""WITH features AS MATERIALIZED (SELECT row_number() OVER () AS rid, f.* FROM ({DEFECTS_SQL}) f),
 cells AS MATERIALIZED (UNPIVOT features ON {", ".join(vocab.FEATURES)} INTO NAME feature VALUE x),
 nodes(tree, node, feature, threshold, low, high, value, weight) AS (VALUES {cells}),
 level0 AS (SELECT rid, replaced, tree, 0 AS node FROM features, ({variants}) v, (SELECT DISTINCT tree FROM nodes))"""
    for level in (1, 2, 3):
        sql += f""", level{level} AS (SELECT a.rid, replaced, a.tree, CASE WHEN n.feature IS NULL THEN a.node
   WHEN (CASE WHEN n.feature = replaced THEN (CASE replaced {usual} END) ELSE c.x END) <= threshold THEN low ELSE high END AS node
   FROM level{level - 1} a JOIN nodes n ON n.tree = a.tree AND n.node = a.node LEFT JOIN cells c ON c.rid = a.rid AND c.feature = n.feature)"""
    return sql + """, scores AS (SELECT rid, replaced, 1 / (1 + exp(-2 * CAST(sum(weight * value) AS DOUBLE))) AS p
   FROM level3 JOIN nodes USING (tree, node) GROUP BY rid, replaced) """


_TABLE_SCORES_SQL = _reached("SELECT '' AS replaced") + """SELECT loc, cyclomatic_complexity_avg, label, round(p, 9) AS probability,
 CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM features JOIN scores USING (rid)"""

_CHANGES_SQL = _reached(
    "SELECT unnest([''" + "".join(f", '{n}'" for n in vocab.FEATURES) + "]) AS replaced"
) + ", changes AS (SELECT rid, replaced, max(p) FILTER (WHERE replaced = '') OVER (PARTITION BY rid) AS whole, whole - p AS gain FROM scores) " + (
    "SELECT label, probability, changed.* EXCLUDE (rid, probability) FROM features f(rid, " + ", ".join(f"own_{n}" for n in vocab.FEATURES)
    + ", label) JOIN (SELECT rid, round(max(whole), 9) AS probability, "
    + ", ".join(f"max(sign(gain) * CAST(format('{{:.4f}}', abs(gain)) AS DOUBLE)) FILTER (WHERE replaced = '{n}') AS {n}" for n in vocab.FEATURES)
    + " FROM changes GROUP BY rid) changed USING (rid)"
)


def _table_scores(spark, d):
    rows = defects.defect_features(view(spark, d, "defect_rows"))
    scored = trees.score(rows, spark.createDataFrame(_NODES, trees.NODES), depth=3)
    return _rounded(scored.select("loc", "cyclomatic_complexity_avg", "label", "probability", "prediction"), "probability")


def _changes(spark, d):
    rows = defects.defect_features(view(spark, d, "defect_rows"))
    changed = trees.contributions(rows, spark.createDataFrame(_NODES, trees.NODES), _USUAL, depth=3)
    parts = [F.col("contributions")[n].alias(n) for n in vocab.FEATURES]
    return _rounded(changed.select("label", "probability", *parts), "probability")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


EVALUATION_SQL = (
    _SPLIT_SQL + ", test AS (SELECT * FROM split WHERE split = 'test')" + _CURVE.format("test") + _CONFUSION.format("test")
    + """SELECT (SELECT count(*) FROM split WHERE split = 'train') AS train_rows,
         (SELECT count(*) FROM split WHERE split = 'validation') AS validation_rows, (SELECT count(*) FROM test) AS test_rows,
         (SELECT sum(label) / count(*) FROM split WHERE split = 'train') AS defect_rate_train,
         CAST(format('{:.4f}', precision) AS DOUBLE) AS precision, CAST(format('{:.4f}', recall) AS DOUBLE) AS recall,
         CAST(format('{:.4f}', f1) AS DOUBLE) AS f1, CAST(format('{:.4f}', roc_auc) AS DOUBLE) AS roc_auc,
         CAST(format('{:.4f}', pr_auc) AS DOUBLE) AS pr_auc FROM report, ranking WHERE class = 1"""
)

QUERIES = {
    "training_split": (
        lambda s, d: split_rows(s, d).select("doc_id", "label", "split"),
        _SPLIT_SQL + "SELECT doc_id, label, split FROM split",
    ),
    "class_balance": (
        lambda s, d: training.class_balance(split_rows(s, d), "label", "split"),
        _SPLIT_SQL + """SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, sum(label) / count(*) AS defect_rate,
         CASE WHEN sum(label) > 0 THEN (1 - sum(label) / count(*)) / (sum(label) / count(*)) ELSE 1 END AS positive_weight
         FROM split GROUP BY split""",
    ),
    "class_report": (
        lambda s, d: evaluation.class_report(view(s, d, "scored")),
        cte("scored") + _CONFUSION.format("scored") + "SELECT * FROM report",
    ),
    "ranking_metrics": (
        lambda s, d: _rounded(evaluation.ranking_metrics(view(s, d, "scored")), "roc_auc", "pr_auc"),
        cte("scored") + _CURVE.format("scored") + "SELECT round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM ranking",
    ),
    "run_evaluation": (
        lambda s, d: evaluation.evaluate(split_rows(s, d)),
        EVALUATION_SQL,
    ),
    "model_table_scores": (_table_scores, _TABLE_SCORES_SQL),
    "substitution_contributions": (_changes, _CHANGES_SQL),
    "model_scores": (_model_scores, None),
    "model_evaluation": (_model_evaluation, None),
    "model_risk": (_model_risk, None),
}
