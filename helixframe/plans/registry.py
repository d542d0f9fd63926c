"""All registered queries with their DuckDB oracles: importing a module of plans registers its queries."""

from helixframe.plans import algorithms, design, files, populations, relations, sequences, tables  # noqa: F401
from helixframe.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
