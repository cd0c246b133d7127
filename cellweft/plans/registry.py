"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cellweft.session import ship


class Tables:
    """The tables of one data directory, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Register a function of :class:`Tables` under ``name``, with its SQL if there is one."""

        def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(Tables(spark, sf_dir))

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return put
