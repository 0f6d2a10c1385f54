"""Registered queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from . import aggregates, files, joins, rules, scalars, streams, windows  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
