"""The whole review as one plan over tables of files and agent responses."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from findmill.operators import dedup, metrics, risk, rules
from findmill.operators.ordering import union_findings
from findmill.session import durable
from findmill.sources.responses import parse_responses


class Review:
    """Results of a review, each a table keyed by report_id, worked out when first asked for.

    As in a review of one archive, the features see the static findings of the metrics
    step only; rule hits and agent findings join afterwards.
    """

    def __init__(self, files: DataFrame, responses: DataFrame) -> None:
        self._files, self._responses = files, responses

    @cached_property
    def _profiled(self) -> DataFrame:
        return durable(metrics.profile_files(self._files), "file-profiles")

    @property
    def file_metrics(self) -> DataFrame:
        return self._profiled.drop("complex_blocks")

    @cached_property
    def features(self) -> DataFrame:
        return metrics.extract_features(self._profiled, metrics.complexity_findings(self._profiled))

    @property
    def predictions(self) -> DataFrame:
        return risk.heuristic_risk(self.features)

    @cached_property
    def findings(self) -> DataFrame:
        complexity = metrics.complexity_findings(self._profiled)
        found = union_findings(parse_responses(self._responses), complexity, rules.scan_rules(self._files))
        # deduplication reads its input several times: parse the responses and scan the files once
        return dedup.deduplicate(durable(found, "review-findings"))


def risk_of_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Source files and static findings -> features -> predictions."""
    return risk.heuristic_risk(metrics.extract_features(metrics.file_metrics(files), findings))


def review(files: DataFrame, responses: DataFrame) -> Review:
    """Metrics, rule scan, response parsing, deduplication and risk of every report."""
    return Review(files, responses)
