"""Ranks, weights and labels looked up in fixed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from findmill import vocab


def lookup(key: Column, table: dict, otherwise=None) -> Column:
    """Literal-table lookup as a CASE, so that it stays in generated code."""
    out = reduce(
        lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])),
        list(table.items())[1:],
        F.when(key == next(iter(table)), F.lit(next(iter(table.values())))),
    )
    return out if otherwise is None else out.otherwise(otherwise)


def severity_rank(severity: Column) -> Column:
    """4 (CRITICAL) .. 0 (INFO); NULL for anything else."""
    return lookup(severity, vocab.SEVERITY_RANK)


def severity_order(severity: Column) -> Column:
    """Reporting order: 0 (CRITICAL) .. 4 (INFO), 5 for anything else."""
    order = {name: i for i, name in enumerate(vocab.SEVERITIES)}
    return lookup(severity, order, F.lit(len(order)))


def severity_weight(severity: Column) -> Column:
    """Weight for the risk score: missing counts as LOW, unknown texts as 1."""
    return lookup(
        F.upper(F.coalesce(severity, F.lit("LOW"))),
        vocab.SEVERITY_WEIGHT,
        F.lit(vocab.UNKNOWN_SEVERITY_WEIGHT),
    )


def severity_class(severity: Column) -> Column:
    upper = F.upper(severity)
    return F.when(upper.isin(vocab.SEVERITIES), F.lower(severity)).otherwise("info")


def score_band(score: Column) -> Column:
    out = F
    for bound, band in vocab.SCORE_BANDS:
        out = out.when(score >= bound, band)
    return out.otherwise(vocab.SCORE_BAND_OTHERWISE)


def scanner_severity(severity: Column) -> Column:
    return lookup(F.upper(severity), vocab.SCANNER_SEVERITY, F.lit("LOW"))


def linter_severity(severity: Column) -> Column:
    return lookup(severity, vocab.LINTER_SEVERITY, F.lit("MEDIUM"))


def linter_confidence(confidence: Column) -> Column:
    return lookup(
        confidence, vocab.LINTER_CONFIDENCE, F.lit(vocab.LINTER_CONFIDENCE_OTHERWISE)
    )


def rule_category(rule_id: Column) -> Column:
    """First category one of whose keywords occurs in the rule id."""
    out = F
    for category, words in vocab.CATEGORY_KEYWORDS.items():
        pattern = "|".join(rf"\Q{w}\E" for w in words)
        out = out.when(F.lower(rule_id).rlike(pattern), category)
    return out.otherwise(vocab.CATEGORY_OTHERWISE)


def is_static_evidence(source: Column, agent: Column) -> Column:
    """The static-evidence tab: static source, or an agent named after the scanner."""
    return (F.coalesce(source == vocab.STATIC, F.lit(False))) | F.coalesce(
        F.lower(agent).contains("semgrep"), F.lit(False)
    )
