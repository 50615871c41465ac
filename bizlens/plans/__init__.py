"""Query catalogue. Importing this package registers every query."""

from bizlens.plans import business, charts, io, ml, profiling, series  # noqa: F401
from bizlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
