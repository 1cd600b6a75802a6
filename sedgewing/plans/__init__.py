"""Queries over the driver's tables, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    """Queries of one module and their oracle SQL, by name."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql:
                self.oracle[name or f.__name__] = sql
            return f

        return keep
