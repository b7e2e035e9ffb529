"""Queries over the shared tables: importing this package registers them all."""

from . import gates, joins, more, scores, sequences, text, timeline  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
