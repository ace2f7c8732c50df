"""Named queries and their DuckDB SQL; importing the query modules fills them."""

from __future__ import annotations

from collections.abc import Callable

from ..lens import SQL_TABLES, Lens

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: bool = True):
    """Register a function of a ``Lens`` as a query, and its SQL over the lens's tables.

    SQL that begins with a comma goes on with more tables before it selects.
    """

    def register(f):
        def run(spark, sf_dir):
            return f(Lens(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = SQL_TABLES + sql if tables else sql
        return f

    return register


from . import codec, counters, integrity, layout, log, mutations, namespace, reports, scalars, streams  # noqa: E402, F401
