"""The queries that the package registers, with their SQL."""

from .plans import files, streams  # noqa: F401
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
