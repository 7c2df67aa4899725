"""All registered queries of the graph engine."""

from __future__ import annotations

from loomgraph.plans import graph_queries, identity_queries, record_queries, text_queries  # noqa: F401  (they register themselves)
from loomgraph.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
