"""Queries over the supplied tables: adapters, one entry per operator, comparison SQL."""

from harness.core import ORACLES, QUERIES
from harness import collectors, maintenance, sessions, streams  # noqa: F401  (register their queries)

__all__ = ["ORACLES", "QUERIES"]
