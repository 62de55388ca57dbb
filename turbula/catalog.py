"""Queries for the operators of the library, by name, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from turbula.plans.queries import inputs, pipelines, sites, statistics, timeaxis, transforms  # noqa: F401 - they register their queries
from turbula.plans.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
