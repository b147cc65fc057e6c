"""All registered queries."""

from __future__ import annotations

from . import credit, parsing, scoring  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
