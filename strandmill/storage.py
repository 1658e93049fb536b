"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from strandmill.session import shared_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: short lineage, and rows that stay as they are."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(file))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
