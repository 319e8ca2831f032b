"""Queries over the tables, each with SQL to hold it against."""

from . import aggregates, cleaning, composite, explain, formats, graphs, network, policy  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
