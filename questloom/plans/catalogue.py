"""Loads every query module so that the registry is complete."""

from __future__ import annotations

from questloom.plans import (  # noqa: F401
    q_answers,
    q_classify,
    q_context,
    q_documents,
    q_patterns,
    q_profile,
    q_query,
    q_sources,
    q_streaming,
    q_thresholds,
    q_traces,
    q_verify,
)
from questloom.plans.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
