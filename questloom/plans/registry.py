"""The list of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession

from questloom.functions.groups import spread
from questloom.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, tuple[str, tuple[str, ...]]] = {}


class Tables:
    """Named inputs of a query: a parquet table or a derived table, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        if name in fx.DERIVED:
            return fx.build(self, name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str, dealt: Collection[str] = ()) -> DataFrame:
        """``text`` over the named tables; the rows of ``dealt`` ones are spread over tasks."""
        for name in names:
            rows = self.load(name)
            (spread(rows) if name in dealt else rows).createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] | list[str] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``uses`` lists derived tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            _TWINS[name] = (oracle, tuple(uses))
        return fn

    return add


def oracles() -> dict[str, str]:
    """The SQL twins with their derived tables in front."""
    return {name: fx.with_derived(text, uses) for name, (text, uses) in _TWINS.items()}
