"""Queries of the engine, by name, with their SQL."""

from .plans import checks, codec, events, figures, texts, urls, vectors  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
