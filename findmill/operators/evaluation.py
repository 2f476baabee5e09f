"""Classifier metrics from a table of labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findmill.functions.rounding import round_exact
from findmill.functions.running import running_total
from findmill.session import durable


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def class_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class (0 and 1)."""
    confusion = scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )
    rows = confusion.select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("class")
    )
    true, said = F.col("label") == F.col("class"), F.col("prediction") == F.col("class")
    counted = rows.groupBy("class").agg(
        F.sum(F.when(true & said, F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(said, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(true, F.col("n")).otherwise(0)).alias("support"),
    )
    return counted.select(
        "class",
        _share(F.col("hits"), F.col("predicted")).alias("precision"),
        _share(F.col("hits"), F.col("support")).alias("recall"),
        _share(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def _curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives at and above every distinct score.

    Rows collapse to distinct scores first.  Running totals then go by ranges of scores with
    about equally many distinct ones, whatever values they have, so no task sorts more than
    one range and there are only as many ranges as shuffle partitions.
    """
    steps = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.sum(1 - F.col(label).cast("bigint")).alias("negatives"),
    ).withColumn("from_top", -F.col("score"))
    # the ranges are sampled: written down, they stay the same for sums and for totals
    steps = durable(steps.repartitionByRange("from_top").withColumn("range", F.spark_partition_id()), "score-steps")
    totals = {"all_positives": F.col("positives"), "all_negatives": F.col("negatives")}
    return running_total(steps, [], "from_top", totals, bucket=F.col("range")).drop("range")


def ranking_metrics(scored: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """One row: roc_auc (ties count half) and pr_auc (step-wise average precision)."""
    totals = F.max("all_positives"), F.max("all_negatives")
    before = F.col("all_positives") - F.col("positives")
    area = F.sum(F.col("negatives") * (before + F.col("positives") / 2))
    precision = F.col("all_positives") / (F.col("all_positives") + F.col("all_negatives"))
    return _curve(scored, label, score).agg(
        _share(area, totals[0] * totals[1]).alias("roc_auc"),
        _share(F.sum(F.col("positives") * precision), totals[0]).alias("pr_auc"),
    )


def evaluate(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "probability",
    split: str = "split",
) -> DataFrame:
    """One metrics row of a run: split sizes, defect rate of the training rows, and the
    test metrics to four decimals."""
    sizes = scored.agg(
        *[F.count_if(F.col(split) == s).alias(f"{s}_rows") for s in ("train", "validation", "test")],
        F.avg(F.when(F.col(split) == "train", F.col(label))).alias("defect_rate_train"),
    )
    test = scored.filter(F.col(split) == "test")
    positive = class_report(test, label, prediction).filter(F.col("class") == 1)
    ranking = ranking_metrics(test, label, score)
    # three one-row tables side by side: stack them and keep the value each column has
    stacked = sizes.unionByName(positive, allowMissingColumns=True).unionByName(
        ranking, allowMissingColumns=True
    )
    joined = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return joined.select(
        "train_rows", "validation_rows", "test_rows", "defect_rate_train",
        *[
            round_exact(F.coalesce(m, F.lit(0.0)), 4).alias(m)
            for m in ("precision", "recall", "f1", "roc_auc", "pr_auc")
        ],
    )


def append_run(row: DataFrame, path: str, run: int) -> None:
    """Append the metrics row of a run to the table of runs."""
    row.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
