"""All registered queries."""

from seqtrail.plans import (  # noqa: F401
    cohort_queries,
    filter_queries,
    markov_queries,
    report_queries,
    retrieval_queries,
    sequence_queries,
    storage_queries,
)
from seqtrail.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
