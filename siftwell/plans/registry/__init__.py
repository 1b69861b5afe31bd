"""Registered queries, each with the SQL that defines its expected result."""

from __future__ import annotations

from siftwell.plans.registry import catalog, contents, matching, segments, settings, workflow
from siftwell.plans.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "contents", "matching", "segments", "settings", "workflow"]
