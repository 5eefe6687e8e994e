"""Registration of named queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def wide(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a table whose texts take long to work on, spread over all cores."""
        return spread(table(self.spark, self.sf_dir, name).select(*columns))


def query(oracle: str = "") -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of ``Tables`` under its name; ``oracle`` is the same in DuckDB's SQL, if SQL can say it."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        run.__doc__ = function.__doc__
        QUERIES[function.__name__] = run
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register
