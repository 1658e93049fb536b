"""The best rows of each group of a stream, as bounded state that outlives restarts."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _place(value) -> tuple:
    """Order of values as Spark sorts them: nulls lowest, NaN highest."""
    if value is None:
        return (0,)
    return (2,) if isinstance(value, float) and math.isnan(value) else (1, value)


class TopRows(StatefulProcessor):
    """Per group: at most ``size`` rows, and how often they have changed.

    Rows of a batch pass through a heap, so a batch of any size takes ``size`` rows of
    memory. When a group's rows change, all of them are sent on under a new revision.
    With ``close_after`` a timer ends a group that many milliseconds of event time after
    its latest row: its rows are sent once more as final, and its state goes.
    """

    def __init__(self, schema: StructType, size: int, order: list[str], time_column: str | None = None, close_after: int | None = None) -> None:
        self.schema, self.size, self.order, self.time_column, self.close_after = schema, size, order, time_column, close_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.schema)
        self.revision = handle.getValueState("revision", "n long")
        self.latest = handle.getValueState("latest", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        before = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        places = [self.schema.fieldNames().index(c) for c in self.order]
        latest = [0]

        def arriving() -> Iterator[tuple]:
            for row in rows:
                if self.close_after is not None and row[self.time_column] is not None:
                    latest[0] = max(latest[0], int(row[self.time_column].timestamp() * 1000))
                yield tuple(row)

        after = heapq.nlargest(self.size, itertools.chain(before, arriving()), key=lambda r: tuple(_place(r[i]) for i in places))
        if self.close_after is not None:
            known = self.latest.get()[0] if self.latest.exists() else 0
            if latest[0] > known:
                if known:
                    self.handle.deleteTimer(known + self.close_after)
                self.handle.registerTimer(latest[0] + self.close_after)
                self.latest.update((latest[0],))
        if after != before:
            self.kept.put(after)
            yield from self._sent(after, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if self.kept.exists():
            yield from self._sent([tuple(r) for r in self.kept.get()], True)
        for state in (self.kept, self.revision, self.latest):
            state.clear()

    def _sent(self, rows: list[tuple], final: bool) -> Iterator[Row]:
        n = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        self.revision.update((n,))
        names = self.schema.fieldNames()
        for row in rows:
            yield Row(**dict(zip(names, row, strict=True)), revision=n, final=final)

    def close(self) -> None:
        pass


def top_rows(stream: DataFrame, by: list[str], size: int, order: list[str], time_column: str | None = None, close_after: int | None = None) -> DataFrame:
    """Revisions of each group's ``size`` rows that are greatest by ``order``, as an append stream.

    Rows of equal order keep the place of their arrival. Null keys are a group. State is
    groups times ``size`` rows; ``close_after`` (milliseconds after a group's latest
    ``time_column``, by a watermark of the stream) bounds the groups as well.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = StructType([*stream.schema.fields, StructField("revision", LongType()), StructField("final", BooleanType())])
    processor = TopRows(stream.schema, size, order, time_column, close_after)
    return stream.groupBy(*by).transformWithState(processor, out, "Append", "None" if close_after is None else "EventTime")


def latest_rows(sent: DataFrame, by: list[str]) -> DataFrame:
    """Each group's rows of its last revision, from what a ``top_rows`` stream has written."""
    last = F.max("revision").over(W.partitionBy(*by))
    return sent.withColumn("_sm_last", last).where("revision = _sm_last").drop("_sm_last", "revision", "final")
