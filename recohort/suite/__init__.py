"""Registered queries over the given tables, each beside its equivalent SQL."""

from recohort.suite import audit, checks, cohorts, ingest, models, ranking, samples, scalars  # noqa: F401
from recohort.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
