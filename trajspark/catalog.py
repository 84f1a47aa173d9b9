"""All queries of the engine over the stock tables, and SQL for them."""

from __future__ import annotations

from .plans import accounting_queries, artifact_queries, comparison_queries, contract_queries, dataset_queries, rule_queries, selection_queries, sequence_queries, source_queries, streaming_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
