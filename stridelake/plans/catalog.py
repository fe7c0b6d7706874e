"""All queries of the engine's own operators and their oracles."""

from stridelake.plans import aggregates, details, filters, functions, graphs, joins, sampling, studies, windows  # noqa: F401
from stridelake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
