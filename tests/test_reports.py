import json
import math
import random

import pytest
from pyspark.sql import functions as F

from findmill import schemas
from findmill.operators import documents, evaluation, export, integrity, marts, narratives, ordering, training
from findmill.functions.running import running_total

TS = "2024-03-04 05:06:07"


def table(spark, name, rows):
    kinds = {f.name: f.dataType.simpleString() for f in schemas.TABLES[name]}
    names = list(rows[0])
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(
        f"{n} {'string' if kinds[n] == 'timestamp_ntz' else kinds[n]}" for n in names))
    return df.select(*[F.col(n).cast(kinds[n]) if n in names else F.lit(None).cast(kinds[n]).alias(n) for n in kinds])


@pytest.fixture(scope="module")
def store(spark):
    counts = dict(critical_count=1, high_count=0, medium_count=1, low_count=0, info_count=1)
    scores = dict(overall_score=72.5, quality_score=85.0, security_score=35.0, performance_score=65.5,
                  maintainability_score=70.0, testing_score=0.0)
    finding = dict(report_id=1, agent="Bug Agent", category="Security", source="ai_detected", file="a.py", line_start=3, line_end=None,
                   title="T", description="d", impact="i", recommendation="r", code_snippet=None, suggested_fix=None, merged_from=None)
    return {
        "users": table(spark, "users", [dict(id=1, name="A", email="a@x", password="h", created_at=TS), dict(id=2, name="B", email="a@x", password="h", created_at=TS)]),
        "repositories": table(spark, "repositories", [
            dict(id=1, user_id=1, repository_name="one", zip_path="1.zip", uploaded_at=TS),
            dict(id=2, user_id=2, repository_name="two", zip_path="2.zip", uploaded_at=TS),
            dict(id=3, user_id=9, repository_name="n" * 256, zip_path="3.zip", uploaded_at=TS)]),
        "reports": table(spark, "reports", [
            dict(id=i, repository_id=repo, summary=f"Done \"{i}\"\n", created_at=TS, **scores, **counts) for i, repo in [(1, 1), (2, 1), (3, 2), (4, 8)]]),
        "analysis_results": table(spark, "analysis_results", [
            dict(id=i, report_id=r, quality_report="q", security_report="", performance_report="", bug_report="", refactoring_report="", documentation_report="")
            for i, r in [(1, 1), (2, 1), (3, 3)]]),
        "findings": table(spark, "findings", [
            dict(finding, id=1, finding_id="x", severity="CRITICAL", confidence=50),
            dict(finding, id=2, finding_id="y", severity="INFO", confidence=90, file=None, code_snippet="c()"),
            dict(finding, id=3, finding_id="z", severity="MEDIUM", confidence=50, line_start=None, agent="Semgrep"),
            dict(finding, id=4, report_id=3, finding_id="w", severity="ODD", confidence=50)]),
        "ml_predictions": table(spark, "ml_predictions", [
            dict(id=1, report_id=1, defect_probability=0.26, maintenance_risk=0.382, review_priority="LOW", human_review_recommended=False,
                 top_risk_factors='["Deep code nesting"]', shap_values="{}", model_version="1.0", model_used="heuristic_fallback", disclaimer="D")]),
    }


def test_filters_and_orders(store):
    found = store["findings"]
    assert marts.filter_findings(found, severity="critical").count() == 1
    assert marts.filter_findings(found, category="SEC%TY").count() == 4
    assert marts.filter_findings(found, agent="_ug").count() == 3
    assert [r.finding_id for r in marts.static_evidence(found).collect()] == ["z"]
    assert [r.id for r in marts.list_findings(found.filter("report_id = 1")).collect()] == [2, 1, 3]
    assert [r.finding_id for r in ordering.by_severity(found, "id").collect()] == ["x", "z", "y", "w"]
    top = ordering.top_findings(found, n=2, tie="id").orderBy("report_id", "rank").collect()
    assert [(r.report_id, r.rank, r.finding_id) for r in top] == [(1, 1, "x"), (1, 2, "z"), (3, 1, "w")]


def test_counts_fill_zeros_and_tenants_stay_apart(store):
    counts = {r.report_id: (r.critical_count, r.info_count, r.total) for r in marts.severity_counts(store["findings"], store["reports"]).collect()}
    assert counts == {1: (1, 1, 3), 2: (0, 0, 0), 3: (0, 0, 1), 4: (0, 0, 0)}
    assert {r.id for r in marts.user_reports(store["reports"], store["repositories"], 1).collect()} == {1, 2}
    assert {r.id for r in marts.user_reports(store["reports"], store["repositories"], 2).collect()} == {3}
    assert marts.owned_findings(store["findings"], store["reports"], store["repositories"], 2).count() == 1
    assert "password" not in marts.public_users(store["users"]).columns
    totals = marts.issue_totals(store["reports"]).first()
    assert (totals.listed_total, totals.export_total, totals.score_band) == (2, 3, "good")
    board = {r.user_id: (r.num_reports, r.avg_score, r.critical_total) for r in marts.dashboard(store["reports"], store["repositories"], store["users"]).collect()}
    assert board == {1: (2, 72.5, 2), 2: (1, 72.5, 1)}
    summary = {r.report_id: r for r in marts.review_summaries(store["reports"], store["findings"], store["ml_predictions"]).collect()}
    assert summary[1].ml_risk_priority == "LOW" and summary[2].ml_risk_priority is None and summary[1].finding_count == 3
    detail = marts.report_details(*[store[n] for n in ("reports", "repositories", "analysis_results", "findings", "ml_predictions")], user_id=2).collect()
    assert [(d.report_id, d.num_findings, [i.finding_id for i in d.top_issues]) for d in detail] == [(3, 1, ["w"])]


def test_texts_of_reports_are_not_broadcast(spark, store, tmp_path):
    """A planner that takes long texts for short ones must not send them all through the driver."""
    names = ("reports", "repositories", "analysis_results", "findings", "ml_predictions")
    for name in names:
        store[name].write.parquet(f"{tmp_path}/{name}")
    df = marts.report_details(*[spark.read.parquet(f"{tmp_path}/{n}") for n in names])
    plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [ln for ln in plan if "Join" in ln and "LeftOuter" in ln]
    assert "SortMergeJoin" in joins[-1], "\n".join(plan)
    assert {r.report_id: r.bug_report for r in df.collect()}.keys() == {1, 2, 3}


def test_violations(store):
    got = {(r.table_name, r.rule, r.column_name, r.key_value) for r in integrity.violations(store).collect()}
    assert got == {
        ("repositories", "orphan", "user_id", "3"), ("reports", "orphan", "repository_id", "4"), ("users", "duplicate", "email", "a@x"),
        ("analysis_results", "duplicate", "report_id", "1"), ("repositories", "too_long", "repository_name", "3")}


@pytest.mark.parametrize("name,ids,left,purged", [
    ("users", [1], {"users": 1, "repositories": 2, "reports": 2, "analysis_results": 1, "findings": 1, "ml_predictions": 0}, {"1.zip"}),
    ("repositories", [2], {"users": 2, "repositories": 2, "reports": 3, "analysis_results": 2, "findings": 3, "ml_predictions": 1}, {"2.zip"}),
    ("reports", [1, 3], {"users": 2, "repositories": 3, "reports": 2, "analysis_results": 0, "findings": 0, "ml_predictions": 0}, set()),
])
def test_erasure(spark, store, name, ids, left, purged):
    survivors, paths = integrity.erase(store, name, spark.createDataFrame([(i,) for i in ids], "id long"))
    assert {n: df.count() for n, df in survivors.items()} == left
    assert {r.zip_path for r in paths.collect()} == purged


def text_of(parts, report):
    rows = documents.in_order(parts.filter(F.col("report_id") == report)).collect()
    return "".join(r.text for r in rows), len(rows)


def test_json_export_in_parts(store, monkeypatch):
    long_pages, few = text_of(export.json_parts(store["reports"], store["findings"], store["ml_predictions"]), 1)
    monkeypatch.setattr(export, "PAGE", 1)
    parts = export.json_parts(store["reports"], store["findings"], store["ml_predictions"])
    whole, many = text_of(parts, 1)
    assert whole == long_pages and few <= many == 5
    doc = json.loads(whole)
    assert list(doc) == ["report_id", "repository_id", "created_at", "overall_score", "scores", "finding_counts", "findings", "ml_prediction", "final_narrative"]
    assert [f["id"] for f in doc["findings"]] == ["y", "x", "z"] and doc["findings"][0]["file"] is None
    assert doc["created_at"] == "2024-03-04T05:06:07" and doc["finding_counts"]["total"] == 3
    assert doc["ml_prediction"]["top_risk_factors"] == ["Deep code nesting"] and doc["final_narrative"] == 'Done "1"\n'
    empty = json.loads(text_of(parts, 2)[0])
    assert empty["findings"] == [] and empty["ml_prediction"] is None


def test_markdown_export(store):
    parts = export.markdown_parts(store["reports"], store["findings"], store["ml_predictions"])
    whole, _ = text_of(parts, 1)
    lines = whole.split("\n")
    assert lines[:4] == ["# AI Code Review Report", "", "**Report ID:** 1", "**Date:** 2024-03-04 05:06 UTC"]
    assert "| Overall | 72 / 100 |" in lines and "| Performance | 66 / 100 |" in lines and "| 🔴 Critical | 1 |" in lines
    assert "| Defect Probability | 26.0% |" in lines and "| Maintenance Risk | 38.2% |" in lines and "- Deep code nesting" in lines
    heads = [ln for ln in lines if ln.startswith("### ") and "[" in ln]
    assert heads == ["### 🔴 [CRITICAL] T", "### 🟡 [MEDIUM] T", "### ℹ️ [INFO] T"]
    assert "**Location:** `a.py` (Lines 3–None)  " in lines and "**Location:** `a.py` (unknown line)  " in lines
    assert whole.endswith('## 4. Full Analysis\n\nDone "1"\n') and "**Code:**\n```\nc()\n```\n" in whole
    assert "## 2. ML" not in text_of(parts, 2)[0]


def test_packed_files(spark):
    files = spark.createDataFrame([(1, "b.py", "y"), (1, "a.py", "x")], "report_id long, path string, content string")
    assert text_of(narratives.packed_files(files), 1)[0] == "FILE: a.py\n```\nx\n```\n\nFILE: b.py\n```\ny\n```"


def test_packed_reports_are_cut_twice(spark):
    names = ["quality_report", "bug_report", "security_report", "performance_report", "refactoring_report", "documentation_report"]
    df = spark.createDataFrame([tuple(["x" * 30000] * 5 + [None])], ", ".join(f"{n} string" for n in names))
    packed = narratives.packed_reports(df).first().packed
    notice = "\n\n[... report truncated for length ...]"
    assert len(packed) == 90_000 + len(notice) and packed.count(notice) == 4
    short = narratives.packed_reports(df.select(*[F.lit(None).cast("string").alias(n) for n in names])).first().packed
    assert short.count("No report available.") == 6


def test_running_total_over_wide_positions(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.randint(0, 9)) for k in "ab" for p in rng.sample(range(500_000), 60)]
    df = running_total(spark.createDataFrame(rows, "k string, p long, v long"), ["k"], "p", {"total": F.col("v")}, width=1000)
    got = {(r.k, r.p): r.total for r in df.collect()}
    for k in "ab":
        total = 0
        for _, p, v in sorted(r for r in rows if r[0] == k):
            total += v
            assert got[k, p] == total


def test_ranking_metrics_match_pair_counting(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.25, 0.5, 0.50001, 0.9, rng.random()])) for _ in range(200)]
    got = evaluation.ranking_metrics(spark.createDataFrame(rows, "label int, probability double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert abs(got.roc_auc - auc) < 1e-9 and abs(got.pr_auc - ap) < 1e-9


def test_class_report_without_predictions(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, prediction int")
    got = {r["class"]: r for r in evaluation.class_report(df).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1, got[1].support) == (0.0, 0.0, 0.0, 2)
    assert got[0].recall == 1.0 and abs(got[0].f1 - 0.5) < 1e-12


def test_training_scores_and_contributions(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        x, y = rng.random(), rng.random()
        rows.append((i, x, y, int(x + 0.2 * rng.random() > 0.6)))
    data = training.with_split(spark.createDataFrame(rows, "id long, loc double, code_lines double, label int"), "id")
    shares = {r.split: r.rows for r in training.class_balance(data, "label", "split").collect()}
    assert 200 < shares["train"] < 280 and shares["validation"] > 40 and shares["test"] > 40
    names = ["loc", "code_lines"]
    model = training.train(data, trees=5, features=names)
    scored = training.score(model, data, names)
    metrics = evaluation.evaluate(scored).first()
    assert metrics.roc_auc > 0.8 and metrics.test_rows == shares["test"]
    parts = training.contributions(model, data, "id", names).first()
    assert set(parts.contributions) == set(names) and 0 <= parts.probability <= 1
    mean = training.contributions(model, data, "id", names).select(*[F.avg(F.abs(F.col("contributions")[n])).alias(n) for n in names]).first()
    assert mean.loc > mean.code_lines


def test_patience_ends_after_the_best():
    assert training.best_count([0.6, 0.5, 0.55, 0.52, 0.51], 3) == (2, True)
    assert training.best_count([0.6, 0.5, 0.55, 0.52, 0.4], 4) == (5, False)
    # what comes after patience has ended is not looked at, and of equal losses the first counts
    assert training.best_count([0.6, 0.5, 0.55, 0.5, 0.1], 2) == (2, True)
    assert training.best_count([0.6, 0.5, 0.4], 20) == (3, False)


def test_boosting_is_cut_back_to_the_least_validation_loss(spark):
    rng = random.Random(8)
    rows = [(i, x, y, int(x + y + 0.6 * rng.random() > 1.3)) for i in range(300) for x, y in [(rng.random(), rng.random())]]
    data = training.with_split(spark.createDataFrame(rows, "id long, loc double, code_lines double, label int"), "id")
    names = ["loc", "code_lines"]
    model = training.train(data, trees=12, features=names, patience=3)
    kept = model.stages[-1]
    held = data.filter("split = 'validation'").withColumn("label", F.col("label").cast("double"))
    for stage in model.stages[:-1]:
        held = stage.transform(held)
    # the loss of every number of trees, by hand
    trees = [[r.prediction for r in t.transform(held).select("id", "prediction").orderBy("id").collect()] for t in kept.trees]
    labels = [r.label for r in held.select("id", "label").orderBy("id").collect()]
    margins, losses = [0.0] * len(labels), []
    for tree, weight in zip(trees, kept.treeWeights):
        margins = [m + weight * p for m, p in zip(margins, tree)]
        losses.append(sum(math.log1p(math.exp(-2 * m if y else 2 * m)) for m, y in zip(margins, labels)) / len(labels))
    assert losses == pytest.approx(training.staged_losses(kept, held))
    assert kept.getNumTrees > 1 and min(losses) == losses[-1]
    # the probabilities are those of these trees
    scored = training.score(model, data.filter("split = 'validation'"), names).orderBy("id").collect()
    assert [r.probability for r in scored] == pytest.approx([1 / (1 + math.exp(-2 * m)) for m in margins])
    # without a limit on patience all trees stay, the first of them the same
    whole = training.train(data, trees=12, features=names, patience=100).stages[-1]
    assert whole.getNumTrees >= kept.getNumTrees
    assert training.first_trees(whole, 2).toDebugString.split("\n", 1)[1] == training.first_trees(kept, 2).toDebugString.split("\n", 1)[1]


def test_positive_weight_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert training.class_balance(df).first().positive_weight == 1.0
