import json

from pyspark.sql import functions as F

from findmill.operators import narratives, validation
from findmill.plans import views
from findmill.sources import defects, files, responses, scanner, sinks, tables
from findmill.streaming.incremental import append_findings

RESPONSES = "report_id long, response_no long, agent string, default_category string, text string"
SCANS = "report_id long, document_no long, root string, json string"


def parse(spark, *texts):
    rows = [(1, i, "Quality Agent", "Quality", t) for i, t in enumerate(texts)]
    found = responses.parse_responses(spark.createDataFrame(rows, RESPONSES))
    return sorted(found.collect(), key=lambda r: r.ord)


def fenced(value, tag="json"):
    return f"Notes\n```{tag}\n{value if isinstance(value, str) else json.dumps(value)}\n```\nEnd"


def test_agent_responses(spark):
    two = [{"id": "q-1", "agent": "someone else", "severity": "HIGH", "confidence": 80, "title": "Long function"},
           {"id": "q-2", "severity": "low", "file": " ", "line_start": "12", "title": ""}]
    got = parse(
        spark, fenced(two), "no fence", fenced("{broken"), fenced({"title": None}, "JSON"),
        fenced([3, "x", {"title": " t ", "severity": " HIGH", "line_start": -3, "file": "a.py"}]) + fenced([{"id": "last"}]),
        fenced([{"confidence": 1e308, "line_start": 0, "line_end": "x"}]).replace("1e+308", "1e999"),
    )
    assert [r.id for r in got[:2]] == ["q-1", "q-2"] and got[-1].id == "last" and len(got) == 5
    assert {r.agent for r in got} == {"Quality Agent"} and {r.source for r in got} == {"ai_detected"}
    assert (got[0].severity, got[0].confidence, got[0].description) == ("HIGH", 80, "No description provided.")
    assert (got[1].severity, got[1].confidence, got[1].file, got[1].line_start, got[1].title) == ("LOW", 60, None, 12, "")
    assert (got[2].title, got[2].category, len(got[2].id)) == ("Untitled finding", "Quality", 64)
    assert (got[3].title, got[3].severity, got[3].line_start, got[3].file) == ("t", "MEDIUM", None, "a.py")
    assert got == sorted(got, key=lambda r: r.ord)


def result(**changes):
    base = {"check_id": "python-eval-use", "path": "/tmp/repo/src/auth.py", "start": {"line": 3}, "end": {"line": 3},
            "extra": {"message": "m", "severity": "ERROR", "lines": "  x = 1 "}}
    return {**base, **changes}


def test_scanner_documents(spark):
    docs = [
        json.dumps({"results": [result(), {"bad": "item"}, 7, result(path=None), result(start={"line": "x"})]}),
        "", "  ", "not json", "[]", '{"results": 3}', "{}",
        json.dumps({"results": [result(path="/other/path/main.py", end={"line": 9}, extra={"severity": "warning", "lines": " "})]}),
        json.dumps({"results": [result(start={}, end=[], extra=3, check_id="perf-loop")]}),
    ]
    rows = [(1, i, "/tmp/repo", d) for i, d in enumerate(docs)]
    got = sorted(scanner.parse_documents(spark.createDataFrame(rows, SCANS)).collect(), key=lambda r: r.ord)
    assert len(got) == 4
    first, bad, outside, bare = got
    assert (first.file, first.line_start, first.line_end, first.severity, first.category) == ("src/auth.py", 3, None, "HIGH", "Security")
    assert (first.code_snippet, first.confidence, first.title) == ("x = 1", 80, "[Semgrep] python-eval-use")
    assert (bad.file, bad.title, bad.severity, bad.category, bad.line_start) == ("unknown", "[Semgrep] unknown-rule", "LOW", "Quality", None)
    assert (outside.file, outside.line_end, outside.severity, outside.code_snippet) == ("main.py", 9, "MEDIUM", None)
    assert outside.description == "python-eval-use"
    assert (bare.category, bare.severity, bare.line_start, bare.description) == ("Performance", "LOW", None, "perf-loop")


def test_linter_issues(spark):
    rows = [(1, 0, "a.py", 5, "HIGH", "LOW", "t", "B1", "text", None, " c "), (1, 1, "a.py", 0, "UNDEFINED", "x", "t", "B2", "text", "CWE-1", None)]
    df = spark.createDataFrame(rows, "report_id long, ord long, file string, lineno long, severity string, confidence string, "
                                     "test string, test_id string, text string, cwe string, code string")
    a, b = scanner.linter_findings(df).orderBy("ord").collect()
    assert (a.severity, a.confidence, a.line_start, a.line_end, a.impact) == ("HIGH", 45, 5, 5, "Bandit test ID: B1. CWE: Unknown")
    assert (b.severity, b.confidence, b.line_start, b.code_snippet) == ("MEDIUM", 60, None, None)


def test_source_tree(spark, tmp_path):
    tree = {"7/src/a.py": b"x\r\ny\rz", "7/src/B.JS": b"ok \xff\xfe", "7/node_modules/c.js": b"no", "7/readme.md": b"no", "8/build/x.py": b"no"}
    for name, data in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {(r.report_id, r.path): r.content for r in files.read_source_files(spark, str(tmp_path)).collect()}
    assert got == {(7, "src/a.py"): "x\ny\nz", (7, "src/B.JS"): tree["7/src/B.JS"].decode("utf-8", "replace")}
    single = files.read_source_files(spark, str(tmp_path / "7"), report_id=5).collect()
    assert {(r.report_id, r.path) for r in single} == {(5, "src/a.py"), (5, "src/B.JS")}
    assert files.list_files(spark, str(tmp_path)).count() == 5


def test_uploads(spark):
    rows = [("in/repo.zip", 10), ("in/Repo.ZIP", 26214401), ("in/repo.tar.gz", 1), ("in/.zip", 1)]
    got = [(r.display_name, r.verdict) for r in files.admit_uploads(spark.createDataFrame(rows, "path string, length long")).collect()]
    assert got == [("repo", "ok"), ("Repo", "too_large"), ("repo.tar", "not_zip"), (".zip", "not_zip")]


def test_archives_fault_order_and_wide_positions(spark):
    rows = [
        ("ok", 0, "a\\b.py", 40), ("ok", 1, "node_modules/../../x", 999), ("ok", 2, "dir/", 999), ("ok", 3, "b.py", 60),
        ("slip", 0, "..\\x", 1), ("slip", 1, "big", 500), ("big", 0, "a", 60), ("big", 1, "b", 41), ("big", 2, "/abs", 1),
    ] + [("long", i * 70_000, f"f{i}", 30) for i in range(5)]
    df = spark.createDataFrame(rows, "archive_id string, pos long, name string, size long")
    got = {r.archive_id: (r.verdict, r.fault_pos) for r in files.admit_archives(df, max_bytes=100).collect()}
    assert got == {"ok": ("ok", None), "slip": ("unsafe_path", 0), "big": ("too_large", 1), "long": ("too_large", 210_000)}


def test_defect_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text(
        "loc,v(g),n,lOCode,lOComment,branchCount,total_Op,uniq_Op,extra,defects\n"
        "10,3,100,8,2,4,50,10,zz,true\n0,,,,,,,,,False\nx,1,1,1,1,1,1,1,1,true\n5,1,1,1,1,1,1,1,1,\n"
    )
    got = defects.read_defects(spark, str(path)).collect()
    assert len(got) == 3 and [r.label for r in got] == [1, 0, 0]
    first = got[0]
    assert (first.num_functions, first.avg_function_length, first.comment_ratio, first.severity_weighted_score) == (5.0, 2.0, 0.2, 11.0)
    assert got[1].comment_ratio == 0.0 and got[1].avg_function_length == 0.0


def test_validation_reasons(spark):
    base = ("i", "a", "c", "HIGH", 50, "t", "d", "m", "r", "ai_detected")
    rows = [base, base[:5] + (None,) + base[6:], base[:3] + ("high",) + base[4:], base[:4] + (101,) + base[5:], base[:-1] + ("x",), base[:-1] + (None,)]
    names = validation.REQUIRED + ["source"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'confidence' else 'string'}" for n in names))
    reasons = [r.reject_reason for r in validation.with_reject_reason(df).collect()]
    assert reasons == [None, "missing title", "unknown severity", "confidence out of range", "unknown source", None]
    assert {r.source for r in validation.valid_findings(df).collect()} == {"ai_detected"}


def test_sinks_round_trip(spark, tmp_path):
    base = str(tmp_path)
    found = responses.parse_responses(
        spark.createDataFrame([(1, 0, "A", "Quality", fenced([{"id": "x", "severity": "HIGH"}, {"id": "y"}]))], RESPONSES)
    ).withColumn("merged_from", F.when(F.col("id") == "x", F.array(F.lit("p"), F.lit("q"))).otherwise(F.col("merged_from")))
    numbered = sinks.stored_findings(found).withColumn("id", F.monotonically_increasing_id())
    for _ in range(2):
        sinks.append(numbered, base, "findings")
    rows = tables.read_table(spark, base, "findings").collect()
    assert len(rows) == 4 and {(r.finding_id, r.merged_from) for r in rows} == {("x", '["p","q"]'), ("y", None)}
    lists = [r[0] for r in tables.read_table(spark, base, "findings").filter("finding_id = 'y'").select(tables.text_list(F.col("merged_from"))).collect()]
    assert lists == [[], []]
    raw = spark.createDataFrame([(1, 1, 0.5)], "id long, report_id long, defect_probability double")
    sinks.append(sinks.stored_predictions(raw), base, "ml_predictions")
    row = tables.read_table(spark, base, "ml_predictions").first()
    assert (row.review_priority, row.top_risk_factors, row.shap_values, row.model_used) == ("UNKNOWN", "[]", "{}", "heuristic_fallback")


def test_json_columns_fall_back(spark):
    df = spark.createDataFrame([('["a"]', '{"x":1.5}'), ("oops", "oops"), (None, None)], "l string, m string")
    got = df.select(tables.text_list(F.col("l")).alias("l"), tables.number_map(F.col("m")).alias("m")).collect()
    assert [(r.l, r.m) for r in got] == [(["a"], {"x": 1.5}), ([], {}), ([], {})]


def test_final_scores(spark):
    rows = [(1, "## 1. Overall Score: 59\n- Quality Score: 85"), (2, "Quality Score: 80\nSecurity Score: 45"), (3, "nothing")]
    got = {r.report_id: r for r in narratives.final_scores(spark.createDataFrame(rows, "report_id long, final_summary string")).collect()}
    assert (got[1].overall_score, got[1].quality_score, got[1].testing_score) == (59.0, 85.0, 0.0)
    assert got[2].overall_score == 62.5 and got[3].overall_score == 0.0


def test_stream_of_responses(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    text = fenced([{"id": "x"}, {"id": "y"}])
    spark.createDataFrame([(1, 0, "A", "Quality", text)], RESPONSES).write.parquet(str(source))
    stream = spark.readStream.schema(RESPONSES).parquet(str(source))
    query = append_findings(stream, responses.parse_responses, str(out), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert {r.id for r in spark.read.parquet(str(out)).collect()} == {"x", "y"}


def test_narratives_in_few_files(spark, tmp_path):
    texts = {n: t for n, t in enumerate(["", "a\nb", "ends\n", "\r\n", "\u00fc \u2028 x", "dup"] * 10)}
    rows = [*texts.items(), (7000, None), (7001, "same"), (7001, "same")]
    sinks.write_narratives(spark.createDataFrame(rows, "report_id long, summary string").coalesce(3), str(tmp_path / "t"))
    got = tables.read_narratives(spark, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, got)) == sorted([*texts.items(), (7000, ""), (7001, "same"), (7001, "same")])
    # as many files as tasks, not as reports
    assert len(list((tmp_path / "t").rglob("part-*"))) <= 3
    few = spark.createDataFrame([(1, "a\nb"), (2, None)], "report_id long, summary string")
    sinks.write_narrative_files(few, str(tmp_path / "f"))
    files = tables.read_narrative_files(spark, str(tmp_path / "f")).collect()
    assert sorted(map(tuple, files)) == [(1, "a\nb"), (2, "")]


def test_small_files_are_dealt_before_long_rows_are_made(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    for name in ("narratives", "reports", "findings", "members"):
        assert views.view(spark, sf_dir, name).rdd.getNumPartitions() >= cores


def test_code_lines_are_looked_up_as_the_case_has_them(spark, sf_dir):
    rows = spark.range(-250, 250).selectExpr("nullif(id, 77) AS k", "concat('l', id) AS l")
    got = rows.selectExpr(f"{views._code_line('k', 'l')} AS a", f"{views._code_case('k', 'l')} AS b")
    assert got.where("a <=> b").count() == 500
    # one look for each line, whatever the number of code lines
    plan = views.source_files(spark, sf_dir).select("content")._jdf.queryExecution().analyzed().toString()
    assert plan.count("WHEN") < len(views.CODE_LINES)
