"""Boosted trees as a table of nodes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from findmill.operators import training, trees

NAMES = ["loc", "code_lines"]
# tree 0: loc <= 10 ? (code_lines <= 3 ? 1 : -1) : 0.5; tree 1: a lone leaf
SMALL = [
    (0, 0, "loc", 10.0, 1, 2, None, 1.0), (0, 1, "code_lines", 3.0, 3, 4, None, 1.0), (0, 2, None, None, None, None, 0.5, 1.0),
    (0, 3, None, None, None, None, 1.0, 1.0), (0, 4, None, None, None, None, -1.0, 1.0),
    (1, 0, None, None, None, None, 0.25, 0.5),
]


def logistic(margin):
    return 1 / (1 + math.exp(-2 * margin))


def test_small_table_by_hand(spark):
    # rows of the table may come in any order
    nodes = spark.createDataFrame(random.Random(1).sample(SMALL, len(SMALL)), trees.NODES)
    rows = [(1, 10.0, 3.0), (2, 10.0, 3.5), (3, 10.5, 3.0), (4, None, None), (5, float("nan"), 0.0)]
    data = spark.createDataFrame(rows, "id long, loc double, code_lines double")
    got = {r.id: (r.probability, r.prediction) for r in trees.score(data, nodes, NAMES).collect()}
    margins = {1: 1.125, 2: -0.875, 3: 0.625, 4: 1.125, 5: 0.625}  # NaN is above every threshold
    assert {i: p for i, (p, _) in got.items()} == pytest.approx({i: logistic(m) for i, m in margins.items()})
    assert {i: q for i, (_, q) in got.items()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1}

    parts = {r.id: r.contributions for r in trees.contributions(data, nodes, {"loc": 20.0, "code_lines": 1.0}, NAMES).collect()}
    assert parts[2] == {
        "loc": round(logistic(-0.875) - logistic(0.625), 4), "code_lines": round(logistic(-0.875) - logistic(1.125), 4),
    }
    assert parts[3] == {"loc": 0.0, "code_lines": 0.0}
    assert trees.score(data.limit(0), nodes, NAMES).count() == 0


def test_node_table_scores_as_the_fitted_model(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(50, 20), rng.choice([0.0, 5.0, 9.0]), int(rng.random() < 0.4)) for i in range(400)]
    rows = [(i, a, b, int((a > 55) != (b > 4)) if i % 10 else y) for i, a, b, y in rows]
    data = training.with_split(spark.createDataFrame(rows, "id long, loc double, code_lines double, label int"), "id")
    model = training.train(data, trees=12, features=NAMES)
    nodes = trees.node_table(model, NAMES)
    assert nodes.select("tree").distinct().count() == len(model.stages[-1].trees)
    assert nodes.count() == model.stages[-1].totalNumNodes

    want = {r.id: r for r in training.score(model, data, NAMES).collect()}
    shown = trees.standardised(data, model, NAMES)
    scored = trees.score(shown, nodes, NAMES)
    for r in scored.collect():
        assert r.probability == pytest.approx(want[r.id].probability, abs=1e-12)
        assert r.prediction == want[r.id].prediction
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0] and "Python" not in plan

    # a standardised feature has mean 0
    parts = {r.id: r.contributions for r in training.contributions(model, data, "id", NAMES).collect()}
    for r in trees.contributions(shown, nodes, dict.fromkeys(NAMES, 0.0), NAMES).collect():
        assert r.contributions == pytest.approx(parts[r.id], abs=1.01e-4)
    far = scored.select(F.max(F.abs(F.col("probability") - 0.5))).first()[0]
    assert far > 0.2
