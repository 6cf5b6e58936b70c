"""Registered queries on the driver's tables, with their oracle SQL."""

from __future__ import annotations

from quarrystone.plans import q_events, q_joins, q_occupancy, q_ranking, q_reports, q_selection, q_sequences, q_sources, q_terms, q_trees, q_values
from quarrystone.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "q_events", "q_joins", "q_occupancy", "q_ranking", "q_reports", "q_selection", "q_sequences", "q_sources", "q_terms", "q_trees", "q_values"]
