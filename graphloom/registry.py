"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
