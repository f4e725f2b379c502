"""Registered queries: the jobs applied to whole tables, each with the SQL that it is held against."""

from quire.plans import agents, evidence, extraction, geometry, layout, progress, provenance, review, streams, work  # noqa: F401
from quire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
