"""Registered queries: each runs a plan over the given tables and states the same result as SQL."""

from ontoweave.catalog import alarms, answers, cases, docs, emergency, generic, graphs, grid, launch, payroll, store, toll  # noqa: F401
from ontoweave.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
