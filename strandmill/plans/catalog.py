"""The library's queries over the driver tables, with SQL oracles."""

from __future__ import annotations

from strandmill.plans import check_queries, curation_queries, filter_queries, operator_queries, sequence_queries, statistics_queries, tree_queries, variant_queries  # noqa: F401
from strandmill.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "subsample_even_orders"
