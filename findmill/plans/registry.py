"""All registered queries by name: (callable, SQL with the same result or None)."""

from __future__ import annotations

from findmill.plans import (
    catalog_evidence,
    catalog_files,
    catalog_findings,
    catalog_reports,
    catalog_review,
    catalog_sources,
    catalog_training,
)

QUERIES = {
    **catalog_findings.QUERIES,
    **catalog_files.QUERIES,
    **catalog_reports.QUERIES,
    **catalog_sources.QUERIES,
    **catalog_training.QUERIES,
    **catalog_review.QUERIES,
    **catalog_evidence.QUERIES,
}
