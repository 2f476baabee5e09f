"""Review tables derived from the benchmark tables, for Spark and as SQL CTEs.

The benchmark tables hold no code and no findings, so each review table is a
projection of one of them over all its rows.  The projections are plain SQL
expressions both engines read alike; where the dialects differ, both are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findmill.session import durable
from findmill.sources.tables import spread


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(selector: str, values: list[str | None]) -> str:
    """CASE that takes the value at ``selector`` modulo the number of values."""
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"CASE ({selector}) % {len(values)} {cases} END"


TITLES = [
    "SQL Injection", "SQL Injection Risk", "Missing null check", "Missing null checks in loop",
    "Path Traversal", "Path traversal in upload handler", "tide", "diet",
]
DESCRIPTIONS = [
    "Query text is built from input.", "Query text is built from the input.",
    "A file name reaches the disk unchecked.", "The value may be null here.", "Unclear loop bounds.",
]
RECOMMENDATIONS = ["", "Bind parameters.", "Check it.", "Validate the path first."]

_K = "o_orderkey"
_MIX = "o_orderkey * 31 + o_custkey * 17"
_START = f"CASE WHEN {_K} % 7 = 0 THEN NULL ELSE {_K} % 40 + 1 END"

FINDING = {
    "report_id": "o_custkey",
    "ord": _K,
    "id": f"CASE WHEN {_K} % 29 = 0 THEN '' WHEN {_K} % 5 = 0 THEN 'dup' "
          f"ELSE concat('f-', CAST({_K} AS STRING)) END",
    "agent": pick(_K, ["Security Agent", "Quality Agent", "Static Analysis (Semgrep)", "Bug Agent", "Static Analysis (Bandit)"]),
    "category": "CASE WHEN o_orderkey % 11 = 0 THEN 'SECURITY' WHEN o_orderstatus = 'O' THEN 'Security' "
                "WHEN o_orderstatus = 'F' THEN 'Bug' ELSE 'Quality' END",
    "severity": "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' "
                "WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END",
    "confidence": "CAST(floor(o_totalprice) AS BIGINT) % 101",
    "source": f"CASE WHEN {_K} % 4 = 0 THEN 'static_analysis' ELSE 'ai_detected' END",
    "file": pick("o_orderkey * 13 + o_custkey", [None, "src/app.py", " SRC/app.py", "src/db.py", "web/main.js"]),
    "line_start": f"CAST({_START} AS BIGINT)",
    "line_end": f"CAST(CASE {_K} % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE {_START} + {_K} % 9 END AS BIGINT)",
    "title": pick(_MIX, TITLES),
    "description": pick("o_orderkey * 5 + o_custkey", DESCRIPTIONS),
    "impact": pick(_K, ["High.", "Low."]),
    "recommendation": pick("o_orderkey * 3 + o_custkey", RECOMMENDATIONS),
    "code_snippet": pick("o_orderkey + o_custkey", [None, "", "x = 1", "call()"]),
    "suggested_fix": pick("o_orderkey * 7 + o_custkey", [None, "", "y = 2"]),
}

STORED_FINDING = {
    "id": _K, "report_id": "o_custkey", "finding_id": FINDING["id"],
    **{n: FINDING[n] for n in FINDING if n not in ("report_id", "ord", "id")},
}

USER = {
    "id": "CAST(r_regionkey AS BIGINT)", "name": "r_name",
    "email": "CASE WHEN r_regionkey % 3 = 0 THEN 'shared@example.org' ELSE concat(lower(r_name), '@example.org') END",
    "password": "concat('hash-', r_name)",
    "created_at": "make_timestamp(2024, 1, 1 + r_regionkey % 28, 0, 0, 0)",
}
REPOSITORY = {
    "id": "CAST(n_nationkey AS BIGINT)",
    "user_id": "CAST(CASE WHEN n_nationkey % 12 = 11 THEN 99 ELSE n_regionkey END AS BIGINT)",
    "repository_name": "CASE WHEN n_nationkey % 9 = 8 THEN repeat(n_name, 60) ELSE n_name END",
    "zip_path": "concat('zips/', n_name, '.zip')",
    "uploaded_at": "make_timestamp(2024, 1 + n_nationkey % 12, 1 + n_nationkey % 7, 0, 0, 0)",
}
_C = "c_custkey"
REPORT = {
    "id": _C,
    "repository_id": f"CAST(CASE WHEN {_C} % 41 = 40 THEN 1000 ELSE c_nationkey END AS BIGINT)",
    "overall_score": "CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 201 AS DOUBLE) / 2",
    "summary": f"concat('Summary of \"', c_name, '\". Security Score: ', CAST({_C} % 150 AS STRING))",
    "created_at": f"make_timestamp(2024, CAST(1 + {_C} % 12 AS INT), CAST(1 + {_C} % 28 AS INT), "
                  f"CAST({_C} % 24 AS INT), CAST({_C} % 60 AS INT), CAST({_C} % 59 AS INT))",
    **{
        f"{s}_score": f"CAST(({_C} * {m}) % 201 AS DOUBLE) / 2"
        for s, m in (("quality", 3), ("security", 7), ("performance", 11), ("maintainability", 13), ("testing", 17))
    },
    **{
        f"{s}_count": f"({_C} * {m}) % {m + 1}"
        for s, m in (("critical", 3), ("high", 4), ("medium", 6), ("low", 8), ("info", 9))
    },
}
_NARRATIVE = {
    "quality_report": f"concat('Quality Score: ', CAST({_C} % 130 AS STRING))",
    "bug_report": pick(_C, ["", "Two bugs."]),
    "security_report": f"CASE WHEN {_C} % 4 = 0 THEN 'no score' ELSE concat('security score:  ', CAST({_C} % 90 AS STRING)) END",
    "performance_report": f"concat('**Performance Score:** 80, Performance Score: ', CAST({_C} % 7 AS STRING))",
    "refactoring_report": f"CASE WHEN {_C} % 5 = 0 THEN NULL ELSE repeat('Split it. ', 500) END",
    "documentation_report": "repeat('Say more. ', 3000)",
}
ANALYSIS = {
    "id": _C,
    "report_id": f"CASE WHEN {_C} % 100 = 7 THEN {_C} - 1 WHEN {_C} % 100 = 9 THEN {_C} + 10000000 ELSE {_C} END",
    **_NARRATIVE,
}
PREDICTION = {
    "id": _C,
    "report_id": _C,
    "defect_probability": f"CAST(({_C} * 37) % 1001 AS DOUBLE) / 1000",
    "maintenance_risk": f"CAST(({_C} * 53) % 1001 AS DOUBLE) / 1000",
    "review_priority": pick(_C, ["HIGH", "MEDIUM", "LOW"]),
    "human_review_recommended": f"{_C} % 2 = 0",
    "top_risk_factors": pick(_C, ['["Deep code nesting","Large file size"]', "[]", None, "not json"]),
    "shap_values": pick(_C, ['{"loc":0.5}', "{}", None, "[1"]),
    "model_version": "'1.0'",
    "model_used": "'heuristic_fallback'",
    "disclaimer": "'Statistical.'",
}
PREDICTED = f"{_C} % 3 <> 0"  # reports that have a prediction

# name -> (source table, columns, filter)
PROJECTIONS = {
    "findings": ("orders", FINDING, None),
    "stored_findings": ("orders", STORED_FINDING, None),
    "users": ("region", USER, None),
    "repositories": ("nation", REPOSITORY, None),
    "reports": ("customer", REPORT, None),
    "analysis_results": ("customer", ANALYSIS, None),
    "ml_predictions": ("customer", PREDICTION, PREDICTED),
    "uploads": (
        "customer",
        {
            "path": f"concat('in/', c_name, {pick(_C, ['.zip', '.ZIP', '.tar.gz', '', '.zip.txt'])})",
            "length": "CAST(floor(abs(c_acctbal) * 4000) AS BIGINT)",
        },
        None,
    ),
    "members": (
        "orders",
        {
            "archive_id": "o_custkey",
            "pos": _K,
            "name": f"concat({pick('o_orderkey * 7 + o_custkey', ['src/', 'lib/../', '.git/', 'docs/', 'a/./b//', 'x/node_modules/', 'app/', 'deep/a/b/c/'])}, "
                    f"CASE WHEN {_K} % 97 = 5 THEN '../../../../../../etc/passwd' WHEN {_K} % 89 = 3 THEN '' "
                    f"ELSE concat('f', CAST({_K} AS STRING), '.py') END)",
            "size": "CAST(floor(o_totalprice * 80) AS BIGINT)",
        },
        None,
    ),
    "scored": (
        "documents JOIN labels USING (doc_id)",
        {
            "doc_id": "doc_id",
            "label": "quality",
            "probability": "CAST((n_chars * 7 + doc_id) % 997 AS DOUBLE) / 1000",
            "prediction": "CASE WHEN (n_chars * 7 + doc_id) % 997 >= 500 THEN 1 ELSE 0 END",
        },
        None,
    ),
    "defect_rows": (
        "part",
        {
            "loc": pick("p_partkey", ["120", "", "0", "44.5", "x", "7"]),
            "v(g)": "CAST(p_size AS STRING)",
            "n": "CAST(p_partkey % 300 AS STRING)",
            "lOCode": "CAST(p_size * 3 AS STRING)",
            "lOComment": "CAST(p_size % 9 AS STRING)",
            "branchCount": "CAST(p_partkey % 17 AS STRING)",
            "total_Op": "CAST(p_partkey % 80 AS STRING)",
            "uniq_Op": "CAST(p_partkey % 25 AS STRING)",
            "defects": pick("p_partkey", ["true", "False", "0", "", "1", "f", "yes"]),
        },
        None,
    ),
    "issues": (
        "events",
        {
            "report_id": "user_id",
            "ord": "event_id",
            "file": "concat('src/', event_type, '.py')",
            "lineno": "event_id % 30",
            "severity": pick("event_id", ["HIGH", "MEDIUM", "LOW", "UNDEFINED"]),
            "confidence": pick("event_id * 3", ["LOW", "HIGH", "UNDEFINED", "MEDIUM"]),
            "test": "concat('check_', event_type)",
            "test_id": "concat('B', CAST(100 + event_id % 20 AS STRING))",
            "text": "concat('Found ', event_type)",
            "cwe": pick("event_id", [None, "CWE-78", "CWE-89"]),
            "code": pick("event_id", ["  x = 1  ", " ", None]),
        },
        None,
    ),
    "narratives": ("customer", {"report_id": _C, **_NARRATIVE}, None),
}

_ITEM = (
    "concat('{{\"check_id\":\"', {rule}, '\",\"path\":\"', {path}, '\",\"start\":{{\"line\":', {start}, '}},"
    "\"end\":{{\"line\":', {end}, '}},\"extra\":{{\"message\":\"Value ', CAST(event_id AS STRING), "
    "'\",\"severity\":\"', {severity}, '\",\"lines\":\"', {lines}, '\"}}}}')"
)
_SCAN_ITEM = _ITEM.format(
    rule=pick("event_id", ["python-eval-use", "js-no-console-log", "cpp-malloc-no-check", "my-loop-rule", "Cpp-Strcpy"]),
    path=pick("event_id * 3", ["/tmp/repo/src/auth.py", "/other/path/main.py", "rel/x.js", "/tmp/repo//a/./b.py"]),
    start="CAST(event_id % 50 AS STRING)",
    end="CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS STRING) ELSE 'null' END",
    severity=pick("event_id * 7", ["ERROR", "WARNING", "INFO", "error", "odd"]),
    lines=pick("event_id", ["  eval(x)  ", "   ", "y"]),
)
PROJECTIONS["scans"] = (
    "events",
    {
        "report_id": "user_id",
        "document_no": "event_id",
        "root": "'/tmp/repo'",
        "json": f"CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'not json' WHEN 2 THEN '{{\"results\":3}}' "
                f"WHEN 3 THEN '{{\"errors\":[]}}' WHEN 4 THEN concat('{{\"results\":[{{\"bad\":\"item\"}},7,', {_SCAN_ITEM}, ']}}') "
                f"ELSE concat('{{\"results\":[', {_SCAN_ITEM}, '],\"errors\":[]}}') END",
    },
    None,
)

_TURN = "(conv_id * 13 + turn)"
_FINDING_JSON = (
    "concat('{\"id\": \"', " + pick(_TURN, ["", "q-1", " s-2 "]) + ", '\", \"agent\": \"other\", \"severity\": \"', "
    + pick(_TURN + " * 3", ["HIGH", "low", " HIGH", "odd"]) + ", '\", \"confidence\": ', "
    + pick(_TURN, ["80", "80.5", "\"80\"", "\"80.5\"", "null", "true", "150", "-1"])
    + ", ', \"file\": ', " + pick(_TURN, ["null", "\" a.py \"", "\"\""])
    + ", ', \"line_start\": ', " + pick(_TURN + " * 5", ["0", "12", "\"7\"", "-3", "\"x\"", "null"])
    + ", ', \"title\": ', " + pick(_TURN, ["\"Long function\"", "null", "\"\""])
    + ", ', \"description\": \"Turn of ', CAST(length(text) AS STRING), ' characters\"}')"
)
PROJECTIONS["responses"] = (
    "conversations",
    {
        "report_id": "conv_id",
        "response_no": "turn",
        "agent": "concat(role, ' agent')",
        "default_category": "'Quality'",
        "text": "concat(replace(text, '`', ' '), chr(10), '## Quality Score: ', CAST(turn * 30 AS STRING), chr(10), "
                f"CASE {_TURN} % 7 WHEN 0 THEN '' WHEN 1 THEN concat('```json', chr(10), '{{broken', chr(10), '```') "
                f"WHEN 2 THEN concat('```JSON', chr(10), {_FINDING_JSON}, chr(10), '```') "
                f"WHEN 3 THEN concat('```json', chr(10), '[3, \"x\", ', {_FINDING_JSON}, ', {{}}]', chr(10), '```', chr(10), "
                f"'```json', chr(10), '[', {_FINDING_JSON}, ']', chr(10), '```') "
                f"ELSE concat('```json', chr(10), '[', {_FINDING_JSON}, ']', chr(10), '```') END)",
    },
    None,
)

# Source files: sentences become lines, and some lines become code, by position
CODE_LINES = [
    "# note", "", "   ", "def fn(a, b):", "    return eval(a)",
    "    if a and b or a and b or a and b or a: pass", "    while a or b or a or b or a or b: pass", "import os", "class C:",
    "    if a and b or a:", 'password = "x"', "os.system(cmd)", "console.log(x);", "el.innerHTML = y;",
    "System.exit(1);", "strcpy(a, b);", "  // note", "\t* star", "    char *p = malloc(4);", "    *p;",
    "        for a in b:", "    def inner(c):", "        while c: assert c",
    "        if " + " and ".join(["c"] * 24) + ": pass",
    # the other rules, each with a line that just misses it
    "exec(code)", "my.exec(code)", "subprocess.run(c, shell=True)", "subprocess.run(c, shell=False)",
    "pickle.loads(b)", "pickle.dumps(b)", "assert a", "asserted = 1", "print(a)", "pprint(a)",
    "except:", "except ValueError:", "def mutable(a=[]):", "def fine(a=None):", "ast.literal_eval(a)",
    "document.write(x);", "documents.write(x);", "Object.prototype.x = 1;", "Object.prototype.x == 1;",
    'const secret = "s";', 'let secret = "s";', "let a: any = 1;", "let a: anything = 1;", "let eval = f(x);", "eval(x);",
    "Runtime.getRuntime().exec(c);", "getRuntime().exec(c);", 'q = "select a from b where c = " + d;', 'q = "select a";',
    "e.printStackTrace();", "e.printStackTrace(s);", 'String password = "p";', 'String name = "p";',
    "gets(a);", "fgets(a);", "strcat(a, b);", "strncat(a, b);", "sprintf(a, b);", "snprintf(a, b);",
    "printf(a);", 'printf("a");', "system(a);", "ecosystem(a);", "el.innerHTML == y;", "strncpy(a, b);",
]
_EXT = pick("doc_id", [".py", ".js", ".ts", ".java", ".cpp", ".py", ".PY", ".md"])
FILE_COLUMNS = {
    "report_id": "CAST(substr(source, 4) AS BIGINT)",
    "path": f"concat(CASE WHEN doc_id % 19 = 3 THEN 'node_modules/' ELSE 'src/' END, lang, '/d', CAST(doc_id AS STRING), {_EXT})",
}


def _code_case(selector: str, line: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN '" + c.replace("'", "''") + "'"
        for i, c in enumerate(CODE_LINES)
    )
    return f"CASE ({selector}) % 101 {cases} ELSE concat('    ', {line}) END"


def _code_line(selector: str, line: str) -> str:
    """What ``_code_case`` takes, by one look into an array: lambdas run every WHEN of a CASE before the one that fits."""
    lines = ", ".join("'" + c.replace("'", "''") + "'" for c in CODE_LINES)
    return f"coalesce(get(array({lines}), CAST(({selector}) % 101 AS INT)), concat('    ', {line}))"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = (
        "array_join(transform(split(replace(text, '. ', concat('.', chr(10))), '\n'), "
        f"(l, i) -> {_code_line('doc_id * 31 + i', 'l')}), '\n')"
    )
    return spread(read(spark, sf_dir, "documents")).selectExpr(
        *[f"{e} AS {n}" for n, e in FILE_COLUMNS.items()], f"{content} AS content", "doc_id"
    )


SOURCE_FILES_SQL = (
    "source_files AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in FILE_COLUMNS.items())
    + ", array_to_string(list_transform(string_split(replace(text, '. ', concat('.', chr(10))), chr(10)), "
    + f"lambda l, i: {_code_case('doc_id * 31 + i - 1', 'l')}), chr(10)) AS content, doc_id FROM documents)"
)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A review table as a DataFrame."""
    if name == "source_files":
        return source_files(spark, sf_dir)
    source, columns, where = PROJECTIONS[name]
    if " JOIN " in source:
        left, right = source.split(" JOIN ")
        df = read(spark, sf_dir, left).join(read(spark, sf_dir, right.split()[0]), "doc_id")
    else:
        # a small file can stand for long rows: every core takes part in deriving them
        df = spread(read(spark, sf_dir, source))
    if where:
        df = df.filter(where)
    return df.selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A review table written as Parquet first, for queries that read it several times."""
    return durable(spread(view(spark, sf_dir, name)), name)


def cte(*names: str) -> str:
    """WITH clause defining review tables in SQL (they shadow nothing: new names)."""
    parts = []
    for name in names:
        if name == "source_files":
            parts.append(SOURCE_FILES_SQL)
            continue
        source, columns, where = PROJECTIONS[name]
        cols = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
        parts.append(f"{name} AS (SELECT {cols} FROM {source}" + (f" WHERE {where})" if where else ")"))
    return "WITH " + ", ".join(parts) + " "
