"""Line, structure and complexity metrics of source files, and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findmill import vocab
from findmill.functions import labels, text
from findmill.functions.rounding import round_exact
from findmill.operators.ordering import number_in_order
from findmill.session import durable

# The line shapes the structure profile looks for
_HEADER = r"^\s*(?:async\s+)?(?:def|class)\s"
_GOOD_HEADER = (
    r"^\s*(?:(?:async\s+)?def\s+[A-Za-z_]\w*\s*[(\[](?!\s*:)"
    r"|class\s+[A-Za-z_]\w*\s*[:(\[])"
)
_FUNCTION = r"^\s*(?:async\s+)?def\s"
_NAME = r"(?:def|class)\s+([A-Za-z_]\w*)"
_IMPORT = r"^\s*(?:import\s+\w|from\s+\S+\s+import\b)"
_DECISION = r"\b(?:if|elif|for|while|except|and|or|assert)\b"
_STRINGS_AND_COMMENT = r"\"[^\"]*\"|'[^']*'|#.*"

_BLOCK = "struct<name:string,is_function:boolean,start:int,end:int,depth:int,complexity:int>"
_TALLY = (
    "struct<functions:int,classes:int,depth:int,length:int,complexity:int,peak:int,complex:int,"
    f"found:array<{_BLOCK}>>"
)
_OPEN = "struct<indent:int,name:string,is_function:boolean,start:int,depth:int,complexity:int>"


def line_metrics(files: DataFrame) -> DataFrame:
    """loc, blank_lines, comment_lines, code_lines, comment_ratio per file.

    Row-local scans of the whole text: no array of lines, no explode, no shuffle.  A
    comment is any line that starts with a comment mark, whatever the language.
    """
    rest = [c for c in files.columns if c != "content"]
    body = F.col("unix_text")
    counted = files.withColumn("unix_text", text.unix_lines(F.col("content"))).select(
        *rest,
        text.count_lines(body).alias("loc"),
        text.count_blank_lines(body).alias("blank_lines"),
        text.count_comment_lines(body).alias("comment_lines"),
    )
    ratio = F.when(F.col("loc") > 0, F.col("comment_lines") / F.col("loc")).otherwise(0.0)
    return (
        counted.withColumn("code_lines", F.col("loc") - F.col("blank_lines") - F.col("comment_lines"))
        .withColumn("comment_ratio", ratio)
        .withColumn("comment_ratio", round_exact(F.col("comment_ratio"), 3))
    )


def _indent(line: Column) -> Column:
    return F.char_length(F.regexp_extract(line, r"^[ \t]*", 0))


def _line_profile(line: Column, i: Column) -> Column:
    header = line.rlike(_HEADER)
    return F.struct(
        (i + 1).alias("no"),
        _indent(line).alias("indent"),
        (~text.is_blank(line) & ~line.rlike(r"^\s*#")).alias("counts"),
        header.alias("header"),
        line.rlike(_FUNCTION).alias("is_function"),
        F.when(header, F.regexp_extract(line, _NAME, 1)).alias("name"),
        F.when(header, 0)
        .otherwise(F.regexp_count(F.regexp_replace(line, _STRINGS_AND_COMMENT, ""), F.lit(_DECISION)))
        .alias("decisions"),
    )


def _counted(tally: Column, ended: Column, last: Column) -> Column:
    """The tally with blocks that end at line ``last``.  Only blocks that become findings are kept."""

    def add(t: Column, b: Column) -> Column:
        function, cc = b["is_function"], b["complexity"]
        one = function.cast("int")
        block = F.struct(b["name"], b["is_function"], b["start"], last.alias("end"), b["depth"], cc).cast(_BLOCK)
        return F.struct(
            (t["functions"] + one).alias("functions"),
            (t["classes"] + 1 - one).alias("classes"),
            F.greatest(t["depth"], b["depth"]).alias("depth"),
            (t["length"] + one * (last - b["start"])).alias("length"),
            (t["complexity"] + one * cc).alias("complexity"),
            F.when(function, F.greatest(t["peak"], cc)).otherwise(t["peak"]).alias("peak"),
            (t["complex"] + (function & (cc > vocab.COMPLEX_FUNCTION_ABOVE)).cast("int")).alias("complex"),
            F.when(function & (cc >= vocab.COMPLEXITY_FINDING_FROM), F.array_append(t["found"], block))
            .otherwise(t["found"]).alias("found"),
        ).cast(_TALLY)

    return F.when(F.size(ended) > 0, F.aggregate(ended, tally, add)).otherwise(tally)


def _step(acc: Column, line: Column) -> Column:
    """Count the blocks this line ends, then open one or count its decisions."""
    ended = F.filter(acc["open"], lambda b: b["indent"] >= line["indent"])
    kept = F.filter(acc["open"], lambda b: b["indent"] < line["indent"])
    opened = F.concat(
        kept,
        F.array(
            F.struct(
                line["indent"], line["name"], line["is_function"], line["no"],
                F.size(kept) + 1, F.lit(1),
            ).cast(_OPEN)
        ),
    )
    innermost = F.size(kept)
    counted = F.when(
        line["decisions"] > 0,
        F.transform(
            kept,
            lambda b: F.struct(
                b["indent"], b["name"], b["is_function"], b["start"], b["depth"],
                F.when(b["depth"] == innermost, b["complexity"] + line["decisions"])
                .otherwise(b["complexity"]),
            ).cast(_OPEN),
        ),
    ).otherwise(kept)
    return F.struct(
        F.when(line["header"], opened).otherwise(counted).alias("open"),
        _counted(acc["tally"], ended, acc["last"]).alias("tally"),
        line["no"].alias("last"),
    )


def tally_blocks(lines: Column) -> Column:
    """Totals over the function and class blocks by indentation, and the complex functions.

    One pass over the lines with a stack of open headers.  A block ends before the next
    counted line that is not deeper; it is added to the totals then, so the work is linear
    in the lines and nothing grows with the file but the list of complex functions.
    """
    profile = F.filter(F.transform(lines, _line_profile), lambda p: p["counts"])
    nothing = F.struct(*[F.lit(0)] * 7, F.array().cast(f"array<{_BLOCK}>")).cast(_TALLY)
    return F.aggregate(
        profile,
        F.struct(
            F.array().cast(f"array<{_OPEN}>").alias("open"),
            nothing.alias("tally"),
            F.lit(0).alias("last"),
        ),
        _step,
        lambda acc: _counted(acc["tally"], acc["open"], acc["last"]),
    )


def structure_metrics(files: DataFrame) -> DataFrame:
    """Structure and complexity columns of Python files (path ends in '.py'), and their
    functions of complexity 15 or more (``complex_blocks``).

    An indentation profile, not a parser: strings over several lines and continued
    lines can differ.  For other languages, and when a header is malformed, every
    column is NULL.
    """
    lines = F.when(F.col("path").endswith(".py"), text.lines(F.col("content")))
    malformed = F.exists(
        "lines", lambda ln: ln.rlike(_HEADER) & ~ln.rlike(_GOOD_HEADER)
    )
    # exploding an array of one keeps a later filter on a metric from repeating the pass
    once = F.explode(F.array(F.when(~malformed, tally_blocks(F.col("lines")))))
    profiled = files.withColumn("lines", lines).select("*", once.alias("tally"))
    count = F.col("tally.functions")
    average = lambda total: F.when(count > 0, total / count).otherwise(0.0)
    columns = {
        "num_functions": count.cast("bigint"),
        "num_classes": F.col("tally.classes").cast("bigint"),
        "num_imports": F.size(F.filter("lines", lambda ln: ln.rlike(_IMPORT))).cast("bigint"),
        "max_nesting_depth": F.col("tally.depth").cast("bigint"),
        "avg_function_length": average(F.col("tally.length")),
        "cyclomatic_complexity_avg": round_exact(average(F.col("tally.complexity")), 2),
        "cyclomatic_complexity_max": F.col("tally.peak").cast("bigint"),
        "num_complex_functions": F.col("tally.complex").cast("bigint"),
    }
    present = F.col("tally").isNotNull()
    return profiled.select(
        *files.columns,
        *[F.when(present, c).alias(name) for name, c in columns.items()],
        F.col("tally.found").alias("complex_blocks"),
    )


def profile_files(files: DataFrame) -> DataFrame:
    """Line, structure and complexity metrics per file (report_id, path, content), and its
    functions of complexity 15 or more (``complex_blocks``), in one pass over the text."""
    return files.transform(structure_metrics).transform(line_metrics)


def file_metrics(files: DataFrame) -> DataFrame:
    """Line, structure and complexity metrics per file (report_id, path, content)."""
    return profile_files(files).drop("complex_blocks")


def complexity_findings(profiled: DataFrame) -> DataFrame:
    """One finding per complex function of ``profile_files``; HIGH from complexity 25."""
    block = F.col("block")
    cc = block["complexity"]
    functions = profiled.select(
        "report_id", "path", F.explode("complex_blocks").alias("block")
    ).withColumn("line", F.col("block.start"))
    # the sort samples its input first: do not profile every file twice
    found = number_in_order(durable(functions, "complex"), "report_id", "path", "line")
    made_id = F.concat(
        F.lit("complexity-"),
        F.left(F.sha2(F.concat_ws("|", "report_id", "path", block["name"], block["start"]), 256), F.lit(16)),
    )
    return found.select(
        "report_id",
        "ord",
        made_id.alias("id"),
        F.lit(vocab.COMPLEXITY_AGENT).alias("agent"),
        F.lit("Quality").alias("category"),
        F.when(cc >= vocab.COMPLEXITY_HIGH_FROM, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.lit(vocab.COMPLEXITY_CONFIDENCE).cast("bigint").alias("confidence"),
        F.lit(vocab.STATIC).alias("source"),
        F.col("path").alias("file"),
        block["start"].cast("bigint").alias("line_start"),
        F.lit(None).cast("bigint").alias("line_end"),
        F.format_string(vocab.COMPLEXITY_TITLE, block["name"], cc).alias("title"),
        F.format_string(vocab.COMPLEXITY_DESCRIPTION, block["name"], cc).alias("description"),
        F.lit(vocab.COMPLEXITY_IMPACT).alias("impact"),
        F.lit(vocab.COMPLEXITY_RECOMMENDATION).alias("recommendation"),
        F.lit(None).cast("string").alias("code_snippet"),
        F.lit(None).cast("string").alias("suggested_fix"),
        F.array().cast("array<string>").alias("merged_from"),
    )


def report_metrics(metrics: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Totals per report; absent values count 0, except in the complexity mean.

    With ``findings``, the static ones of each report are counted too.
    """

    def total(name: str) -> Column:
        return F.sum(F.coalesce(name, F.lit(0)))

    totals = metrics.groupBy("report_id").agg(
        total("loc").alias("total_loc"),
        total("num_functions").alias("total_functions"),
        total("num_classes").alias("total_classes"),
        total("num_imports").alias("total_imports"),
        round_exact(F.coalesce(F.avg("cyclomatic_complexity_avg"), F.lit(0.0)), 2)
        .alias("avg_cyclomatic_complexity"),
        F.count("*").alias("num_files_analyzed"),
        total("code_lines").alias("code_lines"),
        F.coalesce(F.max("max_nesting_depth"), F.lit(0)).alias("max_nesting_depth"),
        F.coalesce(F.avg(F.nullif("avg_function_length", F.lit(0.0))), F.lit(0.0))
        .alias("avg_function_length"),
        F.avg(F.coalesce("comment_ratio", F.lit(0.0))).alias("comment_ratio"),
    )
    if findings is None:
        return totals
    static = finding_totals(findings).select("report_id", "num_static_findings")
    return totals.join(static, "report_id", "left").fillna(0, ["num_static_findings"])


def finding_totals(findings: DataFrame) -> DataFrame:
    """Static and other findings per report, and their severity weight."""
    static = F.coalesce(F.col("source") == vocab.STATIC, F.lit(False))
    return findings.groupBy("report_id").agg(
        F.count_if(static).alias("num_static_findings"),
        F.count_if(~static).alias("num_llm_findings"),
        F.sum(labels.severity_weight(F.col("severity"))).alias("severity_weighted_score"),
    )


def extract_features(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """The twelve model features per report, from file metrics and findings.

    Both sides are aggregated before they meet, so the join is one row to one row.
    """
    joined = report_metrics(metrics).join(finding_totals(findings), "report_id", "full")
    names = {
        "loc": "total_loc",
        "num_functions": "total_functions",
        "num_classes": "total_classes",
        "num_imports": "total_imports",
        "cyclomatic_complexity_avg": "avg_cyclomatic_complexity",
    }
    return joined.select(
        "report_id",
        *[
            F.coalesce(F.col(names.get(name, name)).cast("double"), F.lit(0.0)).alias(name)
            for name in vocab.FEATURES
        ],
    )
