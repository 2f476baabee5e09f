"""Rule scan: literal line patterns over the lines of every source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findmill import rulepack
from findmill.functions import text
from findmill.operators.ordering import number_in_order
from findmill.session import durable
from findmill.sources.scanner import scanner_findings


def _by_language(value) -> Column:
    """CASE on the language: ``value`` of its rules; other languages' rules never run."""
    by_language: dict[str, list] = {}
    for rule in rulepack.RULES:
        by_language.setdefault(rule[1], []).append(rule)
    out = F
    for name, rules in by_language.items():
        out = out.when(F.col("language") == name, value(rules))
    return out


def _may_match(rules: list) -> Column:
    """One pattern for all rules of a language: most lines stop here."""
    two_line = [rulepack.TWO_LINE[rule[0]] for rule in rules if rule[0] in rulepack.TWO_LINE]
    one_line = [rule[3] for rule in rules if rule[0] not in rulepack.TWO_LINE]
    return F.col("line").rlike("|".join(f"(?:{p})" for p in one_line + two_line))


def _matches(rules: list) -> Column:
    """Rules that match the line; patterns are literals, compiled once per task."""
    hits = [
        F.when(
            F.col("lines" if rule_id in rulepack.TWO_LINE else "line").rlike(pattern),
            F.struct(
                F.lit(rule_id).alias("rule_id"),
                F.lit(severity).alias("severity"),
                F.lit(message).alias("message"),
            ),
        )
        for rule_id, _, severity, pattern, message in rules
    ]
    return F.array_compact(F.array(*hits))


def rule_hits(files: DataFrame) -> DataFrame:
    """(report_id, file, line_start, rule_id, severity, message, lines) per matching line.

    No shuffle: files are split into lines, matched and dropped again in one stage.
    """
    code = files.select(
        "report_id",
        F.col("path").alias("file"),
        text.repo_language(F.col("path")).alias("language"),
        text.lines(F.col("content")).alias("all_lines"),
    ).filter("language IS NOT NULL")
    # a line that a two-line rule may start on carries its successor along
    starts = "|".join(rulepack.TWO_LINE.values())
    with_next = F.transform(
        "all_lines",
        lambda line, i: F.when(
            line.rlike(starts),
            F.concat(line, F.lit("\n"), F.coalesce(F.get("all_lines", i + 1), F.lit(""))),
        ).otherwise(line),
    )
    exploded = F.when(F.col("language") == "cpp", with_next).otherwise(F.col("all_lines"))
    return (
        code.select("report_id", "file", "language", F.posexplode(exploded).alias("line_no", "lines"))
        .withColumn("line", F.substring_index("lines", "\n", 1))
        .filter(_by_language(_may_match))
        .select(
            "report_id",
            "file",
            (F.col("line_no") + 1).cast("bigint").alias("line_start"),
            F.col("line").alias("lines"),
            F.explode(_by_language(_matches)).alias("rule"),
        )
        .select("report_id", "file", "line_start", "lines", "rule.*")
    )


def scan_rules(files: DataFrame) -> DataFrame:
    """Findings of the rule scan, numbered by (report, file, line, rule)."""
    # the sort samples its input first: do not scan every file twice
    hits = durable(rule_hits(files), "rule-hits").withColumn("line_end", F.col("line_start"))
    return scanner_findings(
        number_in_order(hits, "report_id", "file", "line_start", "rule_id")
    )
