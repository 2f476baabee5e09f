"""The whole review over small tables."""

import json

from findmill.operators.ordering import by_severity
from findmill.plans.review import review


def test_review_of_two_reports(spark):
    body = "import os\n\ndef f(x):\n    # note\n    return eval(x)\n"
    files = spark.createDataFrame(
        [(1, "a.py", body), (1, "b.js", "console.log(1);\n"), (2, "c.py", "def g(y):\n" + "    if y and y: pass\n" * 8)],
        "report_id long, path string, content string",
    )
    found = [{"id": "s-1", "title": "[Semgrep] python-eval-use", "file": "a.py", "severity": "CRITICAL", "confidence": 60, "line_start": 5}]
    responses = spark.createDataFrame(
        [(1, 0, "Security Agent", "Security", f"```json\n{json.dumps(found)}\n```")],
        "report_id long, response_no long, agent string, default_category string, text string",
    )
    out = review(files, responses)
    rows = by_severity(out.findings, "leader_seq").collect()
    first = rows[0]
    # corroborated (60 + 15), then a second finding and a static one in the group: 75 + 10 + 15
    assert (first.report_id, first.id, first.confidence, first.merged_count) == (1, "s-1", 100, 2)
    assert first.agent == "Security Agent + Static Analysis (Semgrep)" and first.source == "static_analysis"
    assert [r.title for r in rows if r.report_id == 2] == ["High cyclomatic complexity in 'g' (CC=17)"]
    features = {r.report_id: r for r in out.features.collect()}
    assert (features[1].loc, features[1].num_static_findings, features[2].num_static_findings) == (6.0, 0.0, 1.0)
    risks = {r.report_id: r.defect_probability for r in out.predictions.collect()}
    # report 2: complexity 17 (15) and no comments (15); its finding weighs 2
    assert risks[2] == 0.3
    assert out.file_metrics.count() == 3
