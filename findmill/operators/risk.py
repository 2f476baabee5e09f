"""Risk prediction per report from the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findmill import vocab
from findmill.functions import risk
from findmill.functions.rounding import round_exact


def _prediction(
    features: DataFrame, probability: Column, contributions: Column, model: str, disclaimer: str = vocab.RISK_DISCLAIMER
) -> DataFrame:
    """Assemble a prediction; thresholds see the unrounded model probability."""
    maintenance = round_exact(risk.raw_maintenance_risk(), 3)
    factors = F.when(
        F.size(contributions) > 0, risk.contribution_factors(contributions)
    ).otherwise(risk.threshold_factors())
    return features.select(
        "report_id",
        round_exact(probability, 3).alias("defect_probability"),
        maintenance.alias("maintenance_risk"),
        risk.review_priority(probability).alias("review_priority"),
        risk.human_review(probability, maintenance).alias("human_review_recommended"),
        factors.alias("top_risk_factors"),
        contributions.alias("shap_values"),
        F.lit(vocab.MODEL_VERSION).alias("model_version"),
        F.lit(model).alias("model_used"),
        F.lit(disclaimer).alias("disclaimer"),
    )


def heuristic_risk(features: DataFrame) -> DataFrame:
    """Predictions without a trained model: points for thresholds passed."""
    nothing = F.create_map().cast("map<string,double>")
    return _prediction(features, risk.defect_probability(), nothing, vocab.MODEL_HEURISTIC)


def model_risk(
    scored: DataFrame, model: str = vocab.MODEL_TRAINED, disclaimer: str = vocab.RISK_DISCLAIMER
) -> DataFrame:
    """Predictions from a model's ``probability`` and ``contributions`` columns.

    ``model`` and ``disclaimer`` name the model and what it was trained on.
    """
    return _prediction(scored, F.col("probability"), F.col("contributions"), model, disclaimer)
