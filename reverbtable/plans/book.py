"""A small book of named queries with optional SQL twins."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(fn):
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = fn
            if sql:
                self.oracle[name] = sql
            return fn
        return keep
