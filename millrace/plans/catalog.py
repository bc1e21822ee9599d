"""All registered queries."""

from . import contracts, customers, equipment, layers, matching, orders, serving, streams  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
