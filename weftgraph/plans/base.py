"""How queries are registered under their names, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weftgraph.bind import Bound, duckdb_definitions, with_definitions

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
_KNOWN = duckdb_definitions()


def query(sql: str | None = None) -> Callable:
    """Register a function of the bound graph under its own name, with the SQL for the same rows.

    The SQL may begin with further common table expressions; those of the binding stand before them.
    """

    def register(f: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_definitions(sql, _KNOWN)
        return f

    return register
