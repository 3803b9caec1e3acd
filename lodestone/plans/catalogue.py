"""The library's own queries: importing a module of the catalogue registers what it holds."""

from __future__ import annotations

from . import acquisition, content, depth, identity, locators, matching, operations, presence, runtime, scoring, search, store, workflow  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
