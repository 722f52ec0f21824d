"""Registered queries and their SQL twins."""

from tidegauge.plans import availability, catalogue, claims, documents, gateway, hours, lookups, maintenance, presence, readings, records, scope, slugs, streams, vocabulary  # noqa: F401  (importing registers)
from tidegauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
