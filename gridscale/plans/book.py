"""A book of queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
