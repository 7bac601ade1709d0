"""Collects a module's queries: ``query(sql)`` registers a function of the model together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Model, oracle


class Collected:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f: Callable[[Model], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = oracle(sql)
            return f

        return register
