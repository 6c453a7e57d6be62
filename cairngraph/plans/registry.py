"""Queries by name, each with an equivalent DuckDB statement where SQL can express it."""

from __future__ import annotations

from . import q_aggs, q_exprs, q_graph, q_joins, q_more, q_streams, q_text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (q_graph, q_exprs, q_joins, q_aggs, q_text, q_streams, q_more):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
