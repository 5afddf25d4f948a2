"""All registered queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The module of each query.
ORIGIN: dict[str, str] = {}


def with_views(body: str) -> str:
    """SQL that may read the views: their definitions go in front."""
    wanted: list[str] = []
    for name in views.SQL:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
            wanted += [n for n in (*views.NEEDS.get(name, ()), name) if n not in wanted]
    recursive = "RECURSIVE " if body.startswith("RECURSIVE ") else ""
    body = body.removeprefix("RECURSIVE ")
    own = "" if body.lstrip().startswith("SELECT") else body
    listed = ", ".join(f"{n} AS ({views.SQL[n]})" for n in wanted)
    if own:
        return f"WITH {recursive}{listed}{', ' if listed else ''}{own}"
    return f"WITH {recursive}{listed} {body}" if listed else body


def query(name: str, *needed: str, sql: str | None = None):
    """Register a function of views (each a DataFrame, in the order named) as a query."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ORIGIN[name] = f.__module__
        QUERIES[name] = lambda spark, folder: f(*(views.VIEWS[n](spark, folder) for n in needed))
        if sql:
            SQL[name] = with_views(sql.strip())
        return f

    return register


from . import capacity, catalog, flows, logs, pieces, proofs, text  # noqa: E402, F401  they register themselves
