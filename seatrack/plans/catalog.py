"""Loads every module that registers queries."""

from seatrack.plans import (  # noqa: F401
    flagship,
    q_clean,
    q_degrade,
    q_flows,
    q_models,
    q_profile,
    q_risk,
    q_series,
    q_sources,
)
from seatrack.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
