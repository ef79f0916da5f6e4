"""All registered queries of the engine's own operators, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import catalog_log, catalog_retrieval, catalog_sql
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_log", "catalog_retrieval", "catalog_sql"]
