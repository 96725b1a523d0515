"""A registry of queries and their SQL twins for one plan module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        """Registers a query under its function's name; ``oracle`` is its SQL twin."""

        def register(f):
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracles[f.__name__] = oracle
            return f

        return register
