"""Query registry: name -> Spark callable (spark, sf_dir) -> DataFrame, and
name -> DuckDB oracle SQL over the driver's pre-registered views."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.asset import ASSET_SQL

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

# Oracle prefix: the asset view as a leading CTE.
W = f"WITH asset AS ({ASSET_SQL})"


def sql_with_asset(body: str) -> str:
    """``body`` is either ``SELECT ...`` or ``, extra AS (...) SELECT ...``."""
    b = body.strip()
    return f"{W}\n{b}" if b.startswith(",") else f"{W}\n{b}"


def query(name: str, sql: str | None = None, raw_sql: bool = False):
    """Register a query; ``sql`` is prefixed with the asset CTE unless raw."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip() if raw_sql else sql_with_asset(sql)
        return fn
    return deco
