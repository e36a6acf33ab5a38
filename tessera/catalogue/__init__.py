"""Every query of the engine's own operators, with the SQL that must give the same rows."""

from . import discovery, expressions, logs, reports, tables  # noqa: F401  registers
from .registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
