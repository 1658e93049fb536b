"""Session construction and the settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

#: Bound on an Arrow batch, which an executor and its worker hold at once, whatever the
#: length of the texts; it applies where the session names none itself.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(app: str = "strandmill", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), "strandmill-checkpoints"),
    } | conf
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. A local one is taken only
    where driver and executors are one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "strandmill-checkpoints")


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of bounded size."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def ship_library(spark: SparkSession) -> None:
    """Let Python workers import this library wherever the driver started."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if REPO not in known.split(os.pathsep):
        environment["PYTHONPATH"] = REPO + (os.pathsep + known if known else "")
