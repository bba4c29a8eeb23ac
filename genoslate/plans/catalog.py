"""All named queries over the standard tables, each with its SQL counterpart."""

from __future__ import annotations

from . import classes, entities, files, intervals, rules, searches, similarity  # noqa: F401  (they register their queries)
from .roles import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
