import random

from pyspark.sql import functions as F

from findmill.functions import coerce, paths, similarity, text
from findmill.functions.labels import rule_category
from findmill.functions.rounding import round_exact
from findmill.operators import metrics, risk, rules
from findmill.plans.review import risk_of_files
from findmill.rulepack import RULES

SHELF = '''from pathlib import Path
import json

# where readings are kept
STORE = Path("readings.json")


class Shelf:
    slots = 12

    def place(self, label, weight):
        # heavy things go low
        if weight > 20:
            return "bottom:" + label
        return "top:" + label

    class Tag:
        def text(self):
            return "tag"


def load():
    raw = STORE.read_text()
    return json.loads(raw)
'''
NESTED = '''
def timetable(stops, holiday):
    while stops and not holiday:
        stop = stops.pop()
        try:
            with open(stop) as board:
                print(board.read())
        except OSError:
            continue
    return stops
'''
FILES = "report_id BIGINT, path STRING, content STRING"


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


def test_lines_match_splitlines(spark):
    texts = ["", "a", "a\n", "\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "\r\n\r\n", " \t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", text.lines(F.col("t")).alias("l"), text.count_lines(text.unix_lines(F.col("t")))).collect()
    for t, got, n in rows:
        assert got == t.splitlines() and n == len(t.splitlines()), repr(t)


def test_line_metrics_match_plain_python(spark):
    rng = random.Random(5)
    pieces = ["x", " ", "\t", "#", "//", "/*", "*", "'''", '"""', "\n", "\n", "\r\n", "\u2003", "\x1f", "é", "\x0c", "a b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    files = spark.createDataFrame([(1, str(i), t) for i, t in enumerate(texts)], FILES)
    for row in metrics.line_metrics(files).collect():
        lines = texts[int(row.path)].splitlines()
        blank = sum(not ln.strip() for ln in lines)
        comment = sum(ln.strip().startswith(("#", "//", "/*", "*", "'''", '"""')) for ln in lines)
        expected = (len(lines), blank, comment, len(lines) - blank - comment,
                    round(comment / len(lines) if lines else 0.0, 3))
        assert (row.loc, row.blank_lines, row.comment_lines, row.code_lines, row.comment_ratio) == expected


def test_rounding_matches_python(spark):
    rng = random.Random(1)
    values = [2.675, 0.0125, 0.0625, 0.1875, 1 / 80] + [rng.randint(0, 400) / rng.choice([16, 80, 125, 2000]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3, 4):
        got = [r[0] for r in df.select(round_exact(F.col("x"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_structure_of_python_files(spark):
    files = spark.createDataFrame(
        [(1, "shelf.py", SHELF), (1, "nested.py", NESTED), (1, "bad.py", "def broken_syntax(:)"),
         (1, "a.js", "const x = 1;\nfoo();"), (1, "UPPER.PY", "import os"), (1, "empty.py", "")], FILES,
    )
    got = {r.path: r for r in metrics.file_metrics(files).collect()}
    shelf, nested = got["shelf.py"], got["nested.py"]
    assert (shelf.loc, shelf.blank_lines, shelf.comment_lines, shelf.code_lines, shelf.comment_ratio) == (24, 7, 2, 15, 0.083)
    assert (shelf.num_functions, shelf.num_classes, shelf.num_imports, shelf.max_nesting_depth, shelf.avg_function_length) == (3, 2, 2, 3, 7 / 3)
    assert (nested.num_functions, nested.max_nesting_depth, nested.avg_function_length) == (1, 1, 8.0)
    assert nested.cyclomatic_complexity_avg == 4.0  # while, and, except
    for name in ("bad.py", "a.js", "UPPER.PY"):
        assert got[name].num_functions is None and got[name].loc > 0
    assert got["empty.py"].num_functions == 0 and got["empty.py"].loc == 0


def test_structure_takes_time_in_proportion_to_the_lines(spark):
    import time

    block = "class C:\n    def f(self, x):\n        if x and x:\n            return 1\n"
    seconds = []
    for copies in (6_000, 60_000):
        files = spark.createDataFrame([(1, "long.py", block * copies)], FILES)
        start = time.perf_counter()
        row = metrics.structure_metrics(files).select("num_functions", "num_classes", "max_nesting_depth").first()
        seconds.append(time.perf_counter() - start)
        assert tuple(row) == (copies, copies, 2)
    assert seconds[1] < 25 * seconds[0]


def test_complexity_findings(spark):
    body = "def f(x):\n" + "    if x and x:\n        pass\n"
    files = spark.createDataFrame(
        [(1, "m.py", body * 1 + "    if x or x: pass\n" * 6), (1, "h.py", body + "    if x or x: pass\n" * 12), (1, "low.py", body)], FILES
    )
    got = {r.file: r for r in metrics.complexity_findings(metrics.profile_files(files)).collect()}
    assert got["m.py"].severity == "MEDIUM" and got["m.py"].title.endswith("'f' (CC=15)")
    assert got["h.py"].severity == "HIGH" and got["h.py"].confidence == 95
    assert "low.py" not in got


def test_feature_rollup(spark):
    per_file = spark.createDataFrame(
        [(1, 300, 240, 0.133, 4, 30.0, 8.0), (1, 150, 120, 0.1, None, None, None)],
        "report_id long, loc long, code_lines long, comment_ratio double, max_nesting_depth long, "
        "avg_function_length double, cyclomatic_complexity_avg double",
    ).withColumns({n: F.lit(None).cast("long") for n in ("num_functions", "num_classes", "num_imports")})
    findings = spark.createDataFrame(
        [(1, s, src) for s, src in [("HIGH", "static_analysis"), ("MEDIUM", "static_analysis"), ("HIGH", "ai_detected"),
                                    ("LOW", "ai_detected"), ("CRITICAL", "ai_detected")]] + [(2, None, "ai_detected"), (2, "odd", "ai_detected")],
        "report_id long, severity string, source string",
    )
    got = {r.report_id: r for r in metrics.extract_features(per_file, findings).collect()}
    assert got[1].loc == 450 and got[1].code_lines == 360 and got[1].severity_weighted_score == 13
    assert abs(got[1].comment_ratio - 0.1165) < 1e-12
    assert (got[1].max_nesting_depth, got[1].avg_function_length, got[1].cyclomatic_complexity_avg) == (4, 30.0, 8.0)
    assert (got[1].num_static_findings, got[1].num_llm_findings) == (2, 3)
    assert got[2].loc == 0 and got[2].severity_weighted_score == 2


def test_heuristic_risk(spark):
    names = ["loc", "num_functions", "num_classes", "num_imports", "cyclomatic_complexity_avg", "max_nesting_depth",
             "avg_function_length", "comment_ratio", "num_static_findings", "num_llm_findings", "severity_weighted_score", "code_lines"]
    rows = {
        "simple": [200., 10., 2., 8., 5., 3., 20., .15, 1., 2., 5., 160.],
        "high": [2000., 80., 20., 50., 30., 8., 80., .01, 20., 15., 80., 1600.],
        "low": [50., 5., 1., 3., 2., 1., 10., .3, 0., 0., 0., 40.],
        "missing": [None] * 12,
    }
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(rows.values())], "report_id long, " + ", ".join(f"{n} double" for n in names))
    got = [r for r in risk.heuristic_risk(df).orderBy("report_id").collect()]
    assert [(r.defect_probability, r.maintenance_risk, r.review_priority, r.human_review_recommended) for r in got] == [
        (0.26, 0.382, "LOW", False), (1.0, 0.937, "HIGH", True), (0.0, 0.267, "LOW", False), (0.15, 0.3, "LOW", False)]
    assert got[3].top_risk_factors == ["Low documentation/comment ratio"]
    assert got[2].top_risk_factors == ["Metrics within acceptable ranges"]
    assert len(got[1].top_risk_factors) == 5


def test_contribution_factors(spark):
    shap = {"loc": 0.2, "num_imports": -0.3, "code_lines": 0.005, "odd_name": 0.05, "num_classes": 0.02, "num_functions": 0.019, "comment_ratio": 0.018}
    df = spark.createDataFrame([(1, 0.5, shap)], "report_id long, probability double, contributions map<string,double>")
    names = [F.lit(0.0).alias(n) for n in ("cyclomatic_complexity_avg", "comment_ratio", "avg_function_length", "loc",
                                            "severity_weighted_score", "max_nesting_depth", "num_imports")]
    got = risk.model_risk(df.select("*", *names)).first()
    assert got.top_risk_factors == ["High number of dependencies", "Large file size (many lines of code)", "Odd Name",
                                    "Large number of classes", "Large number of functions"]
    assert got.review_priority == "MEDIUM" and got.human_review_recommended


def test_risk_of_files_without_findings(spark):
    files = spark.createDataFrame([(1, "a.py", SHELF)], FILES)
    none = spark.createDataFrame([], "report_id long, severity string, source string")
    row = risk_of_files(files, none).first()
    assert (row.defect_probability, row.maintenance_risk) == (0.16, 0.3)  # three deep: 8 points; few comments: 8 of 100


def test_similarity_values(spark):
    pairs = [("SQL Injection", "SQL Injection Risk", .8387), ("Missing null check", "Missing null checks in loop", .8),
             ("Path Traversal", "Path traversal in upload handler", .6087), ("Low issue", "Medium issue", .5714),
             ("Long function detected", "Missing docstrings", .2), ("Missing docstrings", "Long function detected", .3),
             ("tide", "diet", .25), ("diet", "tide", .5), ("", "", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, r double")
    for row in df.select("r", similarity.title_ratio("a", "b").alias("got")).collect():
        assert round(row.got, 4) == row.r


def test_rule_categories(spark):
    expected_security = {
        "python-eval-use", "python-exec-use", "python-hardcoded-password-assignment", "js-eval-use", "js-hardcoded-secret",
        "ts-eval-use", "ts-hardcoded-secret", "java-runtime-exec", "java-sql-string-concat", "java-hardcoded-password"}
    df = spark.createDataFrame([(r[0],) for r in RULES], "rule string")
    got = dict(df.select("rule", rule_category(F.col("rule"))).collect())
    assert len(got) == 33
    assert {r for r, c in got.items() if c == "Security"} == expected_security
    assert got["cpp-malloc-no-check"] == "Bug" and got["cpp-strcpy-usage"] == "Quality"


HITS = {
    "python-eval-use": ("a.py", "x = eval(y)"), "python-exec-use": ("a.py", "exec(code)"),
    "python-subprocess-shell-true": ("a.py", "subprocess.run(cmd, shell=True)"), "python-os-system": ("a.py", "os.system(c)"),
    "python-pickle-loads": ("a.py", "pickle.load(f)"), "python-hardcoded-password-assignment": ("a.py", "API_KEY = 'x'"),
    "python-assert-used": ("a.py", "  assert x"), "python-print-statement": ("a.py", "print(x)"),
    "python-bare-except": ("a.py", "  except:"), "python-mutable-default-argument": ("a.py", "def f(a, b=[]):"),
    "js-eval-use": ("a.js", "eval(x)"), "js-innerhtml-assignment": ("a.js", "el.innerHTML = x"),
    "js-document-write": ("a.js", "document.write(x)"), "js-no-console-log": ("a.js", "console.log(x)"),
    "js-prototype-pollution": ("a.js", "Object.prototype.x = 1"), "js-hardcoded-secret": ("a.js", 'const token = "x"'),
    "ts-eval-use": ("a.ts", "eval(x)"), "ts-innerhtml-assignment": ("a.ts", "el.innerHTML = x"),
    "ts-no-explicit-any": ("a.ts", "let x: any = 1"), "ts-no-console-log": ("a.ts", "console.log(x)"),
    "ts-hardcoded-secret": ("a.ts", "const secretKey = 'x'"), "java-runtime-exec": ("A.java", "Runtime.getRuntime().exec(x)"),
    "java-sql-string-concat": ("A.java", 'q = "SELECT * FROM t WHERE a=" + a;'), "java-system-exit": ("A.java", "System.exit(1);"),
    "java-printStackTrace": ("A.java", "e.printStackTrace();"), "java-hardcoded-password": ("A.java", 'String password = "x";'),
    "cpp-gets-usage": ("a.cpp", "gets(b);"), "cpp-strcpy-usage": ("a.cc", "strcpy(a, b);"), "cpp-strcat-usage": ("a.h", "strcat(a, b);"),
    "cpp-sprintf-usage": ("a.hpp", "sprintf(a, b);"), "cpp-printf-user-input": ("a.cxx", "printf(input);"),
    "cpp-system-call": ("a.cpp", "system(c);"), "cpp-malloc-no-check": ("a.cpp", "p = (int*) malloc(4);\n  *p;"),
}
MISSES = [("a.py", "literal_eval(x)\nobj.eval(x)\nexcept ValueError:\nname = 'x'"), ("a.js", 'printf("%s", x); a.innerHTML == b'),
          ("a.cpp", 'printf("%s", x);\nfgets(b);\np = malloc(4);\nif (p) *p;'), ("a.md", "eval(x)")]


def test_every_rule_hits_its_line_only(spark):
    rows = [(i, path, "clean\n" + code) for i, (path, code) in enumerate(HITS.values())]
    rows += [(1000 + i, path, code) for i, (path, code) in enumerate(MISSES)]
    got = rules.rule_hits(spark.createDataFrame(rows, FILES)).collect()
    assert {(r.report_id, r.rule_id) for r in got} == set(enumerate(HITS))
    assert {r.line_start for r in got} == {2}


def test_rule_findings_have_scanner_shape(spark):
    found = rules.scan_rules(spark.createDataFrame([(1, "b.py", "x\n  eval(y)  "), (1, "a.py", "eval(z)")], FILES))
    rows = sorted(found.collect(), key=lambda r: r.ord)
    assert [r.file for r in rows] == ["a.py", "b.py"]
    row = rows[1]
    assert (row.title, row.severity, row.category, row.confidence) == ("[Semgrep] python-eval-use", "HIGH", "Security", 80)
    assert (row.line_start, row.line_end, row.code_snippet) == (2, None, "eval(y)")


def test_paths(spark):
    assert one(spark, "a/../../b", paths.escapes_root) is True
    assert one(spark, "a/../b", paths.escapes_root) is False
    assert one(spark, "/abs", paths.escapes_root) is True
    assert one(spark, "x/node_modules/y.js", paths.in_ignored_directory) is True
    assert one(spark, "x/node_modules.js", paths.in_ignored_directory) is False
    assert one(spark, "x/A.PY", paths.is_source) is True
    assert one(spark, "x/.py", paths.is_source) is False
    assert one(spark, "in/archive.tar.gz", paths.stem) == "archive.tar"


def test_scores_and_truncation(spark):
    assert one(spark, "Quality Score: 85", lambda c: text.labelled_score(c, "Quality Score")) == 85.0
    assert one(spark, "quality score  850", lambda c: text.labelled_score(c, "Quality Score")) == 100.0
    assert one(spark, "**Quality Score:** 85", lambda c: text.labelled_score(c, "Quality Score")) == 0.0
    assert one(spark, "no score", lambda c: text.score_by_pattern(c, r"score: (\d+)")) is None
    assert one(spark, "abcdef", lambda c: text.truncate(c, 3)) == "abc\n\n[... report truncated for length ...]"
    assert one(spark, "abc", lambda c: text.truncate(c, 3)) == "abc"
    assert one(spark, "\u2003 x\t", text.strip) == "x"


def test_coercion_of_json_values(spark):
    cases = [("{}", 60), ('{"c":null}', 50), ('{"c":80.5}', 80), ('{"c":"80.5"}', 50), ('{"c":"80"}', 80), ('{"c":true}', 1),
             ('{"c":150}', 100), ('{"c":-1}', 0), ('{"c":[1]}', 50), ('{"c":99999999999}', 100), ('{"c":" +7 "}', 7)]
    df = spark.createDataFrame(cases, "j string, want long").withColumn("v", coerce.field(F.try_parse_json("j"), "c"))
    for row in df.select("j", "want", coerce.as_confidence(F.col("v")).alias("got")).collect():
        assert row.got == row.want, row.j
