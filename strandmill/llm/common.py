"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.session import BATCH_BYTES, BATCH_SETTING, bound_batches, shared_folder, ship_library  # noqa: F401


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, stable rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(file))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Shelf:
    """Tables stored for one call, to be deleted together when nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(stored(df, label))
        return self.tables[-1]

    def clear(self) -> None:
        for df in self.tables:
            forget(df)
        self.tables = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, handed to Python in batches of bounded size."""
    ship_library(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, whatever signs that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole(df: DataFrame) -> list[Column]:
    """All columns by name."""
    return [named(name) for name in df.columns]


def numbered(names: list[str]) -> list[Column]:
    """Columns under working names, as Arrow functions take none with dots."""
    return [named(name).alias(f"_sm_c{i}") for i, name in enumerate(names)]


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with its first columns under their own names again."""
    return df.select(*[F.col(f"_sm_c{i}").alias(name) for i, name in enumerate(names)], *df.columns[len(names) :])


def text_remainder(column: str, modulus: int):
    """crc32 of a key's decimal text, modulo ``modulus``: the fold rule."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for ``mapInArrow`` that hands free memory back at a task's end; Python
    workers outlive tasks, and what they hold counts against their executor."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return tidied
