"""Registered queries, each next to the SQL that must give the same rows."""

from vecflow.catalog import features, search, signals, tables
from vecflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "features", "search", "signals", "tables"]
