"""All registered queries and their SQL oracles."""

from __future__ import annotations

from . import engine, evaluation, guards, hybrids, inputs, retrieval, views  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
