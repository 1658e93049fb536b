"""Bounded samples of labelled rows for fitting, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandmill.llm.common import numbered, restored, text_remainder, tidy


def sampled_labels(labels: DataFrame, column: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids with ``label`` 0 or 1, none of the held-out fold.

    Ids are taken in the order of a hash, so the sample is even and repeatable.
    Null ids, labels other than 0 and 1, and ids with differing labels are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (text_remainder("doc_id", modulus) != held_out))
    single = usable.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other")).where("label = other")
    return single.select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_statistics(docs: DataFrame, sample: DataFrame, statistics: Callable[[bytes], list[float]]) -> list:
    """(label, statistics) of the sampled documents: a bounded list, one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                found = [list(map(float, statistics(text or b""))) for text in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # The sample holds a bounded number of ids.
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    measured = joined.mapInArrow(tidy(run), "doc_id long, label int, found array<double>")
    return [(r.label, r.found) for r in measured.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("found").alias("found")).collect()]


def scored(
    docs: DataFrame, scorer: Callable[[], Callable[[list[bytes]], list[float]]], modulus: int, held_out: int, threshold: float, per_call: int = 500, carry: list[str] | None = None
) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; null texts count as empty.

    ``scorer`` makes a task's scoring function, which may remember what it has seen.

    ``carry`` names columns of ``docs`` to hand on unchanged, doc_id among them if wanted;
    the results' names then begin with ``_sm_``, so no name of a document's column clashes.
    """
    lead = "" if carry is None else "_sm_"
    own = [F.col("doc_id").cast("long").alias("doc_id")] if carry is None else numbered(carry)
    held = F.coalesce(text_remainder("doc_id", modulus) == held_out, F.lit(False))
    rows = docs.select(*own, held.alias(f"{lead}held_out"), F.col("text").cast("binary").alias("_sm_text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for rows in batches:
            for at in range(0, rows.num_rows, per_call):
                part = rows.slice(at, per_call)
                found = score([text or b"" for text in part.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, pa.float64())], [*kept, f"{lead}score"])

    schema = StructType([*rows.schema.fields[:-1], StructField(f"{lead}score", DoubleType())])
    found = rows.mapInArrow(tidy(run), schema)
    found = found.withColumn(f"{lead}predicted", (F.col(f"{lead}score") >= threshold).cast("int"))
    return found if carry is None else restored(found, carry)
