"""Registered queries that write and read back, show row orders, and check the model's parts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window, functions as F

from findmill import schemas, vocab
from findmill.functions import risk
from findmill.operators import erasure, evaluation, integrity, marts, ordering, training
from findmill.plans.catalog_findings import RANK_SQL
from findmill.plans.catalog_reports import TABLE_VIEWS, tables
from findmill.plans.catalog_sources import DEFECTS_SQL
from findmill.plans.catalog_training import EVALUATION_SQL, split_rows
from findmill.plans.views import cte, read, view
from findmill.session import shared_folder
from findmill.sources import defects, sinks
from findmill.sources.tables import read_narratives, read_tables


def _folder(spark, name):
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


# --- tables written and read back ------------------------------------------------------


def _counted(found):
    rows = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))
        for name, df in found.items()
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def _counted_sql(where):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows, CAST(coalesce(sum(id), 0) AS BIGINT) AS ids FROM {source} WHERE {where[name]}"
        for name, source in TABLE_VIEWS.items()
    )


def _stored(spark, d):
    base = _folder(spark, "tables")
    for name, df in tables(spark, d).items():
        absent = {f.name: F.lit(None).cast(f.dataType) for f in schemas.TABLES[name] if f.name not in df.columns}
        df = df.withColumns(absent) if absent else df
        for half in (0, 1):  # the second write must append
            sinks.append(df.where(F.col("id") % 2 == half), base, name)
    return _counted(read_tables(spark, base))


def _survivors(spark, d):
    base = _folder(spark, "survivors")
    users = read(spark, d, "region").select(F.lit(1).cast("bigint").alias("id")).distinct()
    integrity.write_survivors(integrity.erase(tables(spark, d), "users", users)[0], base)
    return _counted(read_tables(spark, base))


def _erased_files(spark, d):
    """Tables in many files, users erased one at a time, read from the last snapshot."""
    base = _folder(spark, "snapshots")
    for name, df in tables(spark, d).items():
        absent = {f.name: F.lit(None).cast(f.dataType) for f in schemas.TABLES[name] if f.name not in df.columns}
        sinks.append((df.withColumns(absent) if absent else df).repartitionByRange("id"), base, name)
    erasure.track(spark, base)
    users = read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))
    for user in (1, 77):  # the second one does not exist
        erasure.erase_stored(spark, base, "users", users.select(F.lit(user).cast("bigint").alias("id")).distinct())
    return _counted(erasure.tables_at(spark, base))


_OWNED = "report_id NOT IN (SELECT id FROM gone)"
_SURVIVORS_SQL = cte(*TABLE_VIEWS.values()) + """, gone AS (SELECT r.id FROM reports r JOIN repositories o
   ON o.id = r.repository_id WHERE o.user_id = 1) """ + _counted_sql({
    "users": "id <> 1", "repositories": "user_id <> 1", "reports": "id NOT IN (SELECT id FROM gone)",
    "analysis_results": _OWNED, "findings": _OWNED, "ml_predictions": _OWNED,
})


def _narratives(spark, d):
    path = _folder(spark, "narratives")
    sinks.write_narratives(view(spark, d, "reports").select(F.col("id").alias("report_id"), "summary"), path)
    return read_narratives(spark, path).select("report_id", F.md5("text").alias("digest"))


def _runs(spark, d):
    path = _folder(spark, "runs")
    for run in (1, 2):
        evaluation.append_run(evaluation.evaluate(split_rows(spark, d)), path, run)
    return evaluation.read_runs(spark, path)


# --- row orders ------------------------------------------------------------------------


def _placed(df, group):
    """Add ``place``: the position of each row among those of its group, as the rows come."""
    order = Window.partitionBy(group).orderBy("__at")
    return df.withColumn("__at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(order)).drop("__at")


# --- the model's parts --------------------------------------------------------------------


def _scaled(spark, d):
    rows = defects.defect_features(view(spark, d, "defect_rows"))
    scaled = training.scaled_features(rows, rows.where("label = 0"))
    return scaled.select("label", *[F.round(n, 6).alias(n) for n in vocab.FEATURES])


_SCALED_SQL = "WITH features AS (" + DEFECTS_SQL + "), fitted AS (SELECT * FROM features WHERE label = 0) SELECT label, " + ", ".join(
    f"round(coalesce(({n} - (SELECT avg({n}) FROM fitted)) / nullif((SELECT stddev_samp({n}) FROM fitted), 0), 0), 6) AS {n}"
    for n in vocab.FEATURES
) + " FROM features"

# contributions by feature, of all sizes and signs, with ties and an unknown name
_PARTS = {
    "loc": "(o_orderkey % 41 - 20) / 100.0", "num_imports": "(o_custkey % 31 - 15) / 100.0",
    "comment_ratio": "(o_orderkey % 17 - 8) / 800.0", "max_nesting_depth": "(o_orderkey % 41 - 20) / -100.0",
    "num_functions": "(o_custkey % 13) / 100.0", "code_lines": "(o_orderkey % 5) / 100.0", "odd_name": "(o_custkey % 7 - 3) / 10.0",
}


def _factors(spark, d):
    pairs = ", ".join(f"'{n}', CAST({e} AS DOUBLE)" for n, e in _PARTS.items())
    rows = read(spark, d, "orders").selectExpr("o_orderkey", f"map({pairs}) AS parts")
    return rows.select("o_orderkey", F.array_join(risk.contribution_factors(F.col("parts")), "; ").alias("factors"))


def _factors_sql():
    place = {n: i for i, n in enumerate(vocab.FEATURES)}
    entries = ", ".join(
        f"struct_pack(size := -abs(CAST({e} AS DOUBLE)), at := {place.get(n, len(place))}, name := '{n}')" for n, e in _PARTS.items()
    )
    known = " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in vocab.CONTRIBUTION_LABELS.items())
    other = " ".join(f"WHEN '{n}' THEN '{n.replace('_', ' ').title()}'" for n in _PARTS if n not in vocab.CONTRIBUTION_LABELS)
    return (
        f"SELECT o_orderkey, array_to_string(list_transform(list_filter(list_sort([{entries}])[1:{vocab.MAX_FACTORS}], "
        f"lambda e: e.size < -{vocab.MIN_CONTRIBUTION}), lambda e: CASE e.name {known} {other} END), '; ') AS factors FROM orders"
    )


QUERIES = {
    "stored_tables": (_stored, cte(*TABLE_VIEWS.values()) + _counted_sql(dict.fromkeys(TABLE_VIEWS, "true"))),
    "erasure_survivors": (_survivors, _SURVIVORS_SQL),
    "erased_files": (_erased_files, _SURVIVORS_SQL),
    "narrative_texts": (_narratives, cte("reports") + "SELECT id AS report_id, md5(summary) AS digest FROM reports"),
    "evaluation_runs": (_runs, f"SELECT e.*, run FROM ({EVALUATION_SQL}) e, (VALUES (1), (2)) v(run)"),
    "findings_by_severity": (
        lambda s, d: _placed(ordering.by_severity(view(s, d, "findings"), "ord"), "report_id").select("report_id", "ord", "place"),
        cte("findings") + f"SELECT report_id, ord, row_number() OVER (PARTITION BY report_id ORDER BY {RANK_SQL} DESC, "
        "confidence DESC, ord) AS place FROM findings",
    ),
    "findings_by_confidence": (
        lambda s, d: _placed(marts.list_findings(view(s, d, "findings"), tie="ord"), "report_id").select("report_id", "ord", "place"),
        cte("findings") + "SELECT report_id, ord, row_number() OVER (PARTITION BY report_id ORDER BY confidence DESC, ord) AS place FROM findings",
    ),
    "reports_newest_first": (
        lambda s, d: _placed(marts.user_reports(view(s, d, "reports"), view(s, d, "repositories")), "user_id").select("user_id", "id", "place"),
        cte("reports", "repositories") + """SELECT o.user_id, r.id, row_number() OVER (PARTITION BY o.user_id
          ORDER BY r.created_at DESC, r.id DESC) AS place FROM reports r JOIN repositories o ON o.id = r.repository_id""",
    ),
    "repositories_newest_first": (
        lambda s, d: _placed(marts.user_repositories(view(s, d, "repositories")), "user_id").select("user_id", "id", "place"),
        cte("repositories") + """SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, id DESC)
          AS place FROM repositories""",
    ),
    "scaled_features": (_scaled, _SCALED_SQL),
    "contribution_factors": (_factors, _factors_sql()),
}
