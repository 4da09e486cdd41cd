"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from siltstone.operators import action_log, chunks, digests, files, intervals, maintenance, metrics, more, relations, requests, rules, search, segmentation, sensitivity, tag_changes, tag_table, tags, text_index, text_rules, trees, vector_index
from siltstone.plans.flagship import flagship
from siltstone.sources import folder
from siltstone.streaming import timers

_MODULES = (search, text_rules, tags, relations, files, metrics, chunks, more, maintenance, rules, tag_changes, requests, text_index, vector_index, intervals, timers, action_log, trees, folder, digests, tag_table, segmentation, sensitivity)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
