"""Imports every module that registers queries."""

from tripspark.plans import causal, describe, gold_tables, governance, inference, learning, longrun, sources, space, streams  # noqa: F401
from tripspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
