"""All registered queries."""

from noticeboard.plans import (  # noqa: F401
    queries_facts, queries_health, queries_ledger, queries_notices, queries_rounds, queries_sources)
from noticeboard.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
