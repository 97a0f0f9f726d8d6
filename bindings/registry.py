"""A small helper: one module-level dict of queries and one of SQL checks per binding file."""
from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn
        return wrap
