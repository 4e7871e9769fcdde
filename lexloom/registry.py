"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: Inventory entries that each query applies.
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(function):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name], COVERS[name] = function, covers
        if sql:
            SQL[name] = sql
        return function

    return add


from .plans import detail_plans, ingest_plans, service_plans, store_plans, text_plans, usage_plans, work_plans  # noqa: E402,F401  they register their queries
