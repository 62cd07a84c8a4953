"""The registered queries over the fixture tables."""

from vigilmill.plans import catalog_queries, evaluation_queries, guard_queries, learned_queries, learning_queries, nested_queries, reading_queries, rule_queries, session_queries, state_queries, study_queries, text_queries, trace_queries, value_queries, whole_queries  # noqa: F401
from vigilmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
