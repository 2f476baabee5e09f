"""Scanner output documents and linter issue rows -> findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findmill import vocab
from findmill.functions import coerce, labels, paths
from findmill.functions.once import computed_once
from findmill.functions.text import blank_to_null
from findmill.operators.ordering import order_text


def explode_results(documents: DataFrame) -> DataFrame:
    """Object items of ``results`` of each document (report_id, document_no, root, json).

    Empty text, broken JSON, and a missing or non-array ``results`` yield no rows.
    """
    parsed = documents.select(
        "report_id", "document_no", "root",
        coerce.field(F.try_parse_json("json"), "results").alias("results"),
    )
    return parsed.select(
        "report_id", "document_no", "root",
        F.posexplode(coerce.array_of(F.col("results"))).alias("item_no", "item"),
    ).filter(coerce.is_object(F.col("item")))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Findings of scanner documents.  Absent fields take defaults; only items whose
    path or line numbers have an impossible type are dropped."""
    item, c = F.col("item"), F.col
    names = {
        "check_id": "check_id", "path": "path", "message": "extra.message", "severity": "extra.severity",
        "lines": "extra.lines", "start_line": "start.line", "end_line": "end.line",
    }
    fields = computed_once(
        explode_results(documents), ["report_id", "document_no", "root", "item_no"],
        {name: coerce.field(item, at) for name, at in names.items()},
    )
    is_text = lambda v: coerce.json_type(v) == "STRING"
    usable = (c("path").isNull() | is_text(c("path"))) & _line_ok(c("start_line")) & _line_ok(c("end_line"))
    values = {
        "usable": usable,
        "ord": order_text(c("document_no"), c("item_no")),
        "rule_id": _plain(c("check_id"), F.lit("unknown-rule")),
        "path": F.coalesce(F.try_variant_get("path", "$", "string"), F.lit("unknown")),
        "lines": F.when(is_text(c("lines")), F.try_variant_get("lines", "$", "string")),
        "line_start": coerce.as_number(c("start_line")),
        "line_end": coerce.as_number(c("end_line")),
        "said": _plain(c("message"), F.lit(None).cast("string")),
        "severity": _plain(c("severity"), F.lit("INFO")),
    }
    flat = computed_once(fields, ["report_id", "root"], values).filter("usable")
    located = computed_once(
        flat, ["report_id", "ord", "rule_id", "severity", "lines"],
        {
            "file": paths.relative_to(c("path"), c("root")),
            "message": F.coalesce("said", "rule_id"),
            "line_start": c("line_start").cast("bigint"),
            "line_end": c("line_end").cast("bigint"),
        },
    )
    return scanner_findings(located)


def scanner_findings(hits: DataFrame) -> DataFrame:
    """Findings of scanner hits (report_id, ord, rule_id, message, severity, file,
    line_start, line_end, lines)."""
    rule = F.col("rule_id")
    made_id = F.concat(
        F.lit("semgrep-"),
        F.left(F.sha2(F.concat_ws("|", "report_id", "ord", "rule_id", "file", "line_start"), 256), F.lit(16)),
    )
    return hits.select(
        "report_id",
        "ord",
        made_id.alias("id"),
        F.lit(vocab.SCANNER_AGENT).alias("agent"),
        labels.rule_category(rule).alias("category"),
        labels.scanner_severity(F.col("severity")).alias("severity"),
        F.lit(vocab.SCANNER_CONFIDENCE).cast("bigint").alias("confidence"),
        F.lit(vocab.STATIC).alias("source"),
        "file",
        F.col("line_start").cast("bigint").alias("line_start"),
        F.nullif("line_end", "line_start").cast("bigint").alias("line_end"),
        F.concat(F.lit(vocab.SCANNER_TITLE), rule).alias("title"),
        F.col("message").alias("description"),
        F.concat(F.lit(vocab.SCANNER_IMPACT), rule).alias("impact"),
        F.lit(vocab.SCANNER_RECOMMENDATION).alias("recommendation"),
        blank_to_null(F.col("lines")).alias("code_snippet"),
        F.lit(None).cast("string").alias("suggested_fix"),
        F.array().cast("array<string>").alias("merged_from"),
    )


def linter_findings(issues: DataFrame) -> DataFrame:
    """Findings of security-linter issues (report_id, ord, file, lineno, severity,
    confidence, test, test_id, text, cwe, code)."""
    line = F.nullif("lineno", F.lit(0)).cast("bigint")
    made_id = F.concat(
        F.lit("bandit-"),
        F.left(F.sha2(F.concat_ws("|", "report_id", "ord", "test_id", "file"), 256), F.lit(16)),
    )
    return issues.select(
        "report_id",
        "ord",
        made_id.alias("id"),
        F.lit(vocab.LINTER_AGENT).alias("agent"),
        F.lit("Security").alias("category"),
        labels.linter_severity(F.col("severity")).alias("severity"),
        labels.linter_confidence(F.col("confidence")).cast("bigint").alias("confidence"),
        F.lit(vocab.STATIC).alias("source"),
        "file",
        line.alias("line_start"),
        line.alias("line_end"),
        F.col("test").alias("title"),
        F.col("text").alias("description"),
        F.format_string(
            vocab.LINTER_IMPACT, F.col("test_id"), F.coalesce("cwe", F.lit("Unknown"))
        ).alias("impact"),
        F.lit(vocab.LINTER_RECOMMENDATION).alias("recommendation"),
        blank_to_null(F.col("code")).alias("code_snippet"),
        F.lit(None).cast("string").alias("suggested_fix"),
        F.array().cast("array<string>").alias("merged_from"),
    )


def _plain(v: Column, absent: Column) -> Column:
    """Text form without trimming; only an absent value takes the default."""
    kind = coerce.json_type(v)
    return (
        F.when(v.isNull(), absent)
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .otherwise(F.to_json(v))
    )


def _line_ok(v: Column) -> Column:
    """Absent, null, or a whole number (also spelled as text)."""
    number = coerce.as_number(v)
    fraction = F.when(
        coerce.json_type(v).startswith("DECIMAL") | (coerce.json_type(v) == "DOUBLE"),
        F.try_variant_get(v, "$", "double") != number,
    )
    return v.isNull() | (coerce.json_type(v) == "VOID") | (
        number.isNotNull() & ~F.coalesce(fraction, F.lit(False))
    )
