"""Registered queries over the driver's tables and their SQL twins, by topic."""

from __future__ import annotations

from witness.queries import corpus, evidence, views
from witness.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "evidence", "views"]
