"""Queries and their SQL, kept side by side in every module of this package."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(fn):
            key = name or fn.__name__
            self.queries[key] = fn
            if sql:
                self.oracle[key] = sql
            return fn

        return add
