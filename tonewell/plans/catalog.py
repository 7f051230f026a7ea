"""All registered queries; importing this module fills the registry."""

from tonewell.plans import (  # noqa: F401
    catalog_corpus,
    catalog_jobs,
    catalog_joins,
    catalog_metrics,
    catalog_readers,
    catalog_signal,
    catalog_text,
    catalog_tokens,
    catalog_training,
    catalog_vectors,
)
from tonewell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
