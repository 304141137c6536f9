"""Registered queries: each key has a Spark plan and, where SQL can say it, an equivalent SQL text."""

from cohortspark.plans import q_clean, q_cohort, q_evaluate, q_records, q_tokens  # noqa: F401
from cohortspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
