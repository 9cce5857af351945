"""Registered queries, each with the SQL text that gives the same rows."""

from tidemark.plans.queries import corrections, curves, rows, summaries, visits  # noqa: F401
from tidemark.plans.queries.registry import QUERIES, SQL  # noqa: F401
