"""Registration of queries with their SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.session import bound_batches, shared_folder, ship_library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of a folder by name, and new paths for files that a query writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def fresh(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{uuid.uuid4().hex}-{name}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, tables) as a query; ``tables(name)`` reads an input."""

    def keep(function: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_library(spark)
            bound_batches(spark)
            return function(spark, Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep
