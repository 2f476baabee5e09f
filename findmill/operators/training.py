"""Defect classifier: split, scaling, boosted trees, scoring and contributions (MLlib)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findmill import vocab
from findmill.functions.rounding import round_exact
from findmill.session import durable


def split_of(key: Column, label: Column) -> Column:
    """train / validation / test (60/20/20) by a hash of the key within each label.

    The same row always falls on the same side, on any cluster, without a sort.
    """
    digest = F.substring(F.md5(F.concat_ws("|", label.cast("string"), key.cast("string"))), 1, 6)
    bucket = F.conv(digest, 16, 10).cast("bigint") % 100
    return F.when(bucket < 60, "train").when(bucket < 80, "validation").otherwise("test")


def with_split(data: DataFrame, key: str, label: str = "label") -> DataFrame:
    return data.withColumn("split", split_of(F.col(key), F.col(label)))


def class_balance(data: DataFrame, label: str = "label", *keys: str) -> DataFrame:
    """Rows, positives, defect rate and weight of the positive class (1.0 without any)."""
    n, positives = F.count("*"), F.count_if(F.col(label) == 1)
    rate = F.try_divide(positives.cast("double"), n)
    return data.groupBy(*keys).agg(
        n.alias("rows"),
        positives.alias("positives"),
        rate.alias("defect_rate"),
        F.when(positives > 0, (1 - rate) / rate).otherwise(1.0).alias("positive_weight"),
    )


def feature_stages(features: list[str] | None = None) -> list:
    """Assemble in fixed order and standardise."""
    return [
        VectorAssembler(
            inputCols=features or vocab.FEATURES, outputCol="raw_features", handleInvalid="error"
        ),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def best_count(losses: list[float], patience: int) -> tuple[int, bool]:
    """Trees up to the least loss, and whether ``patience`` trees after it gained nothing.

    Losses are by number of trees; of equal ones the first counts, and what comes after the end of
    patience is not looked at.
    """
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def staged_losses(model: GBTClassificationModel, data: DataFrame) -> list[float]:
    """Log-loss on ``data`` (features, label) of the first tree, the first two, and so on."""
    # MLlib's loss of a margin is twice the log-loss of its probability
    return [loss / 2 for loss in model.evaluateEachIteration(data)]


def first_trees(model: GBTClassificationModel, trees: int) -> GBTClassificationModel:
    """The model that boosting had after so many trees."""
    java, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    kept = gateway.new_array(ml.regression.DecisionTreeRegressionModel, trees)
    weights = gateway.new_array(gateway.jvm.double, trees)
    for i in range(trees):
        kept[i], weights[i] = java.trees()[i], float(model.treeWeights[i])
    return GBTClassificationModel(ml.classification.GBTClassificationModel(model.uid, kept, weights))


def train(
    data: DataFrame,
    trees: int = vocab.TREES,
    features: list[str] | None = None,
    seed: int = 42,
    patience: int = vocab.PATIENCE,
) -> PipelineModel:
    """Fit on rows (features, label, split): scaler and trees on train rows, with the
    validation rows deciding where to stop.

    Boosting stops after ``patience`` trees without a lower log-loss on the validation rows
    and is cut back to the best; without validation rows all trees stay.  MLlib can't look at
    the loss between trees, so the trees are fitted again in twice the number until patience
    ends; the first ones are the same each time.  ``StandardScaler`` divides by the sample
    deviation (n - 1).
    """
    names = features or vocab.FEATURES
    data = data.fillna(0.0, names)
    weight = class_balance(data.filter("split = 'train'")).first()["positive_weight"]
    fit_on = data.filter("split <> 'test'").select(
        *names,
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1, float(weight)).otherwise(1.0).alias("weight"),
        (F.col("split") == "validation").alias("is_validation"),
    )
    scaling = Pipeline(stages=feature_stages(names)).fit(fit_on.filter("NOT is_validation"))
    scaled = durable(scaling.transform(fit_on).select("features", "label", "weight", "is_validation"), "training-rows")
    shown, held = scaled.filter("NOT is_validation"), scaled.filter("is_validation")
    judged = not held.isEmpty()
    count, ended = (min(trees, patience + 5) if judged else trees), False
    while True:
        booster = GBTClassifier(
            featuresCol="features",
            labelCol="label",
            weightCol="weight",
            maxIter=count,
            maxDepth=vocab.TREE_DEPTH,
            stepSize=vocab.LEARNING_RATE,
            subsamplingRate=vocab.ROW_SHARE,
            featureSubsetStrategy=str(vocab.FEATURE_SHARE),
            cacheNodeIds=False,
            seed=seed,
        )
        model = booster.fit(shown)
        if judged:
            best, ended = best_count(staged_losses(model, held), patience)
        if ended or count >= trees:
            break
        count = min(trees, 2 * count)
    if judged and best < count:
        model = first_trees(model, best)
    return PipelineModel(stages=[*scaling.stages, model])


def scaled_features(data: DataFrame, fit_on: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``data`` with its features centred and divided by the sample deviation of ``fit_on``."""
    names = names or vocab.FEATURES
    model = Pipeline(stages=feature_stages(names)).fit(fit_on.fillna(0.0, names))
    scaled = model.transform(data.fillna(0.0, names)).withColumn("scaled", vector_to_array("features"))
    return scaled.select(
        *[c for c in data.columns if c not in names], *[F.col("scaled")[i].alias(n) for i, n in enumerate(names)]
    )


def score(model: PipelineModel, features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add ``probability`` (of a defect) and ``prediction``."""
    kept = features.columns
    out = model.transform(features.fillna(0.0, names or vocab.FEATURES))
    return out.select(
        *kept,
        vector_to_array("probability")[1].alias("probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def contributions(
    model: PipelineModel, features: DataFrame, key: str, names: list[str] | None = None
) -> DataFrame:
    """Per row the map feature -> change of probability when that feature takes its
    training mean, to four decimals.

    A substitution contribution, not a Shapley value: each row is scored once more per
    feature (twelve), in one pass.
    """
    names = names or vocab.FEATURES
    means = dict(zip(names, [float(m) for m in model.stages[1].mean]))
    base = features.select(key, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    variants = base.withColumn(
        "replaced", F.explode(F.array(F.lit(""), *[F.lit(n) for n in names]))
    ).withColumns(
        {n: F.when(F.col("replaced") == n, F.lit(means[n])).otherwise(F.col(n)) for n in names}
    )
    scored = score(model, variants, names)
    whole = F.max(F.when(F.col("replaced") == "", F.col("probability")))
    by_name = F.map_from_entries(
        F.collect_list(F.when(F.col("replaced") != "", F.struct("replaced", "probability")))
    )
    return (
        scored.groupBy(key)
        .agg(whole.alias("probability"), by_name.alias("others"))
        .select(
            key,
            "probability",
            F.transform_values(
                "others",
                lambda k, v: F.signum(F.col("probability") - v)
                * round_exact(F.abs(F.col("probability") - v), 4),
            ).alias("contributions"),
        )
    )
