"""The library's queries; importing this registers them."""

from . import aggregates, compositions, evidence, filters_and_joins, history, retrieval, traversal  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
