"""Boosted trees as a table: one row per node, scored inside each row.

A node table has one row per node of each tree: ``tree``, ``node`` (0 is the root, without
gaps), ``feature`` (its name, NULL at a leaf), ``threshold``, ``low`` and ``high`` (the nodes
for values up to and above the threshold), ``value`` (of a leaf) and ``weight`` (of the tree).

Scoring folds over trees and levels with higher-order functions.  The ensemble comes in as a
scalar subquery, so there is no join, no shuffle and no Python whatever the number of rows; it
holds at most trees * 2^(depth + 1) nodes, which training bounds.  Contributions score each
row once more per feature in the same fold, where a table of variants would have to be
exploded and grouped again.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findmill import vocab
from findmill.functions.rounding import round_exact
from findmill.session import shared_folder

NODES = "tree int, node int, feature string, threshold double, low int, high int, value double, weight double"


def node_table(model: PipelineModel, names: list[str] | None = None) -> DataFrame:
    """Nodes of a fitted model (its last stage), read from its stored form."""
    spark, names = SparkSession.active(), names or vocab.FEATURES
    path = os.path.join(shared_folder(spark), f"trees-{uuid.uuid4().hex}")
    model.stages[-1].write().save(path)
    # the stored columns go by position: not all of them have names
    weights = spark.read.parquet(path + "/treesMetadata").toDF("treeID", "metadata", "weight").drop("metadata")
    stored = spark.read.parquet(path + "/data").toDF("treeID", "nodeData").select("treeID", "nodeData.*")
    stored = stored.join(weights.hint("merge"), "treeID")
    inner = F.col("leftChild") >= 0
    name = F.element_at(F.array(*map(F.lit, names)), F.col("split.featureIndex") + 1)
    return stored.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(inner, name).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("low"),
        F.when(inner, F.col("rightChild")).alias("high"),
        F.when(~inner, F.col("prediction")).alias("value"),
        "weight",
    )


def standardised(features: DataFrame, model: PipelineModel, names: list[str] | None = None) -> DataFrame:
    """Features as the trees of a fitted model see them: missing ones 0, centred and scaled."""
    scaler = model.stages[1]
    scaled = {}
    for n, mean, deviation in zip(names or vocab.FEATURES, scaler.mean, scaler.std):
        value = F.coalesce(F.col(n).cast("double"), F.lit(0.0))
        scaled[n] = (value - F.lit(float(mean))) * F.lit(1.0 / float(deviation) if deviation else 0.0)
    return features.withColumns(scaled)


def ensemble(nodes: DataFrame, names: list[str] | None = None) -> Column:
    """All trees, in order, as one value (a scalar subquery): per tree its weight and its nodes by number."""
    known = F.array(*map(F.lit, names or vocab.FEATURES))
    at = F.nullif(F.array_position(known, F.col("feature")), F.lit(0)).cast("int") - 1
    trees = nodes.groupBy("tree").agg(
        F.max("weight").alias("weight"),
        F.array_sort(F.collect_list(F.struct("node", at.alias("at"), "threshold", "low", "high", "value"))).alias("nodes"),
    )
    return trees.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes")))).scalar()


def margin(trees: Column, values: Column, depth: int = vocab.TREE_DEPTH) -> Column:
    """Weighted sum of the leaves that a row's ``values`` (an array, as the features) reach."""

    def descend(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            here = tree["nodes"][node]
            down = F.when(values[here["at"]] <= here["threshold"], here["low"]).otherwise(here["high"])
            return F.when(here["at"].isNull(), node).otherwise(down)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)

    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + tree["weight"] * tree["nodes"][descend(tree)]["value"])


def _probability(total: Column) -> Column:
    """Logistic of twice the margin: leaves are half log-odds."""
    return 1.0 / (1.0 + F.exp(-2.0 * total))


def _held(features: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """With ``__in``: the ensemble and the row's values, an array of one that expressions look into."""
    values = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    # a subquery can't stand inside a higher-order function
    held = features.withColumns({"__trees": ensemble(nodes, names), "__values": values})
    return held.withColumn("__in", F.array(F.struct("__trees", "__values"))).drop("__trees", "__values")


def score(
    features: DataFrame, nodes: DataFrame, names: list[str] | None = None, depth: int = vocab.TREE_DEPTH
) -> DataFrame:
    """Add ``probability`` (of a defect) and ``prediction`` (1 above one half).

    Missing features count as 0.  ``depth`` is that of the deepest tree, or more.
    """
    names = names or vocab.FEATURES
    found = F.transform("__in", lambda i: _probability(margin(i["__trees"], i["__values"], depth)))[0]
    scored = _held(features, nodes, names).withColumn("probability", found).drop("__in")
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def contributions(
    features: DataFrame,
    nodes: DataFrame,
    means: dict[str, float],
    names: list[str] | None = None,
    depth: int = vocab.TREE_DEPTH,
) -> DataFrame:
    """Add ``probability`` and ``contributions``: feature -> change of probability, to four decimals,
    when that feature takes its value in ``means`` (0 for standardised features)."""
    names = names or vocab.FEATURES
    usual = F.array(*[F.lit(float(means[n])) for n in names])

    def probabilities(trees: Column, values: Column) -> Column:
        """Of the row itself, then with each feature in turn at its mean."""

        def one(i: Column) -> Column:
            replaced = F.transform(values, lambda v, j: F.when(j == i, usual[j]).otherwise(v))
            return F.transform(F.array(replaced), lambda r: _probability(margin(trees, r, depth)))[0]

        return F.transform(F.sequence(F.lit(-1), F.lit(len(names) - 1)), one)

    def changes(found: Column) -> Column:
        gains = F.transform(F.slice(found, 2, len(names)), lambda p: found[0] - p)
        return F.struct(
            found[0].alias("probability"),
            F.map_from_arrays(
                F.array(*map(F.lit, names)), F.transform(gains, lambda g: F.signum(g) * round_exact(F.abs(g), 4))
            ).alias("contributions"),
        )

    found = F.transform("__in", lambda i: F.transform(F.array(probabilities(i["__trees"], i["__values"])), changes)[0])
    held = _held(features, nodes, names).select(*features.columns, F.explode(found).alias("__changes"))
    return held.select(*features.columns, "__changes.*")
