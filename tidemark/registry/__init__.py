"""Registered queries (Spark) and their DuckDB oracle SQL, keyed alike."""

from tidemark.registry.queries import ORACLE_SQL, QUERIES
from tidemark.registry import jobs as _jobs  # noqa: F401  (registers supporting jobs)
from tidemark.registry import primitives as _primitives  # noqa: F401  (per-primitive keys)
from tidemark.registry import incremental as _incremental  # noqa: F401  (incremental jobs)

__all__ = ["QUERIES", "ORACLE_SQL"]
