"""Queries by name with their SQL; the modules of plans/ add theirs on import."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from .plans import curation, splitting  # noqa: E402, F401  they register their queries
