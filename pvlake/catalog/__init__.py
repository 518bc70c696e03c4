"""Every operator as a named query over the driver's tables, with its SQL twin."""

from .registry import QUERIES, SQL, load

__all__ = ["QUERIES", "SQL", "load"]
