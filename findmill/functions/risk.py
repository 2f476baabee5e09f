"""Heuristic risk scores as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from findmill import vocab


def feature(name: str) -> Column:
    """A feature column, missing values as 0."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _tier(value: Column, bounds, reached) -> Column:
    out = F
    for bound, points in bounds:
        out = out.when(reached(value, bound), points)
    return out.otherwise(0)


def risk_points() -> Column:
    """Points out of 100: high values of four features, low values of one."""
    parts = [
        _tier(feature(name), bounds, lambda v, b: v >= b)
        for name, bounds in vocab.RISK_POINTS_FROM.items()
    ] + [
        _tier(feature(name), bounds, lambda v, b: v < b)
        for name, bounds in vocab.RISK_POINTS_BELOW.items()
    ]
    return reduce(Column.__add__, parts)


def defect_probability() -> Column:
    return risk_points() / float(vocab.RISK_POINTS_TOTAL)


def raw_maintenance_risk() -> Column:
    """Weighted complexity, missing comments and function length, at most 1."""
    return F.least(
        feature("cyclomatic_complexity_avg") / 30 * 0.4
        + (1 - feature("comment_ratio")) * 0.3
        + feature("avg_function_length") / 100 * 0.3,
        F.lit(1.0),
    )


def review_priority(probability: Column) -> Column:
    return (
        F.when(probability >= vocab.PRIORITY_HIGH_FROM, "HIGH")
        .when(probability >= vocab.PRIORITY_MEDIUM_FROM, "MEDIUM")
        .otherwise("LOW")
    )


def human_review(probability: Column, maintenance: Column) -> Column:
    return (probability >= vocab.HUMAN_REVIEW_PROBABILITY) | (
        maintenance >= vocab.HUMAN_REVIEW_MAINTENANCE
    )


def threshold_factors() -> Column:
    """Texts of the thresholds passed, in fixed order, at most five."""
    texts = []
    for name, comparison, bound, text in vocab.THRESHOLD_FACTORS:
        value = feature(name)
        passed = value >= bound if comparison == ">=" else value < bound
        texts.append(F.when(passed, text))
    found = F.slice(F.array_compact(F.array(*texts)), 1, vocab.MAX_FACTORS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(vocab.NO_FACTORS)))


def contribution_factors(contributions: Column) -> Column:
    """Labels of the five largest contributions (map) by absolute value, above 0.01."""
    entries = F.map_entries(contributions)
    position = {name: i for i, name in enumerate(vocab.FEATURES)}
    order = F.create_map(*[F.lit(x) for kv in position.items() for x in kv])
    label = F.create_map(*[F.lit(x) for kv in vocab.CONTRIBUTION_LABELS.items() for x in kv])
    ranked = F.array_sort(
        F.transform(
            entries,
            lambda e: F.struct(
                (-F.abs(e["value"])).alias("negated"),
                F.coalesce(F.try_element_at(order, e["key"]), F.lit(len(position))).alias("at"),
                e["key"].alias("name"),
            ),
        )
    )
    top = F.filter(
        F.slice(ranked, 1, vocab.MAX_FACTORS),
        lambda e: e["negated"] < -vocab.MIN_CONTRIBUTION,
    )
    return F.transform(
        top,
        lambda e: F.coalesce(
            F.try_element_at(label, e["name"]), F.initcap(F.replace(e["name"], F.lit("_"), F.lit(" ")))
        ),
    )
