"""All queries registered."""

from sessionlore.catalog import aggregates, basics, features, learning  # noqa: F401
from sessionlore.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
