"""Writers: tables, sequences, node data, variant calls, logs."""

from __future__ import annotations

import datetime as dt
import json
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents above this many bytes are written without indentation.
MINIFY_ABOVE = 5_000_000
CODECS = {".gz": "gzip", ".bz2": "bzip2", ".zst": "zstd"}


def codec(path: str) -> str:
    """Compression by a path's extension."""
    return next((c for end, c in CODECS.items() if path.endswith(end)), "none")


def write_table(df: DataFrame, path: str, separator: str = "\t", single: bool = False) -> None:
    """Delimited text with a header; ``single`` writes one file, for small results."""
    (df.coalesce(1) if single else df).write.option("compression", codec(path)).csv(path, sep=separator, header=True, emptyValue="", quote='"', escape='"')


def write_in_order(df: DataFrame, path: str, order: str = "row", separator: str = "\t") -> None:
    """Delimited text whose files, read by name, hold the rows by ``order``, which is not
    written: ranges of the order go to as many tasks as there is data for."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order).drop(order)
    placed.write.option("compression", codec(path)).csv(path, sep=separator, header=True, emptyValue="", quote='"', escape='"')


def fasta_lines(df: DataFrame, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(id_column), F.lit("\n"), F.col(sequence)).alias("value"))


def write_fasta(df: DataFrame, path: str, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    """Writes records and returns the rows without their sequence."""
    fasta_lines(df, id_column, sequence).write.option("compression", codec(path)).text(path)
    return df.drop(sequence)


def write_ndjson(df: DataFrame, path: str) -> None:
    """JSON lines; raises on NaN or infinite numbers."""
    numbers = [name for name, kind in df.dtypes if kind in ("double", "float")]
    checked = df.withColumns({n: F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.raise_error(F.lit(f"{n} is not finite"))).otherwise(F.col(n)) for n in numbers})
    checked.write.option("compression", codec(path)).option("ignoreNullFields", "false").json(path)


class Encoder(json.JSONEncoder):
    """Dates, times, durations and UUIDs as text; sets as sorted lists."""

    def default(self, value):
        if isinstance(value, dt.date | dt.time):
            return value.isoformat()
        if isinstance(value, dt.timedelta):
            return f"PT{value.total_seconds():g}S"
        if isinstance(value, uuid.UUID):
            return str(value)
        if isinstance(value, set | frozenset):
            return sorted(value)
        return super().default(value)


def dump(document: dict, minify: bool | None = None) -> str:
    """A document as JSON text, indented unless it is large."""
    text = json.dumps(document, cls=Encoder, allow_nan=False, separators=(",", ":"))
    small = len(text) <= MINIFY_ABOVE if minify is None else not minify
    return json.dumps(document, cls=Encoder, allow_nan=False, indent=2) if small else text


def node_data(df: DataFrame, node: str = "node", generated_by: dict | None = None) -> dict:
    """``{nodes: {name: {attribute: value}}}`` of a node table; trees fit the driver."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    nodes = {r.pop(node): {k: v for k, v in r.items() if v is not None} for r in rows}
    return ({"generated_by": generated_by} if generated_by else {}) | {"nodes": nodes}


def node_entries(spark, *documents: dict) -> DataFrame:
    """(node, path, value, ord) of node data documents, nested attributes by dotted path."""
    rows = []
    for order, document in enumerate(documents):
        if "nodes" not in document or not isinstance(document["nodes"], dict):
            raise ValueError("node data lack the object 'nodes'")
        for node, attributes in document["nodes"].items():
            stack = [("", attributes)]
            while stack:
                path, value = stack.pop()
                if isinstance(value, dict):
                    stack += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
                else:
                    rows.append((node, path, json.dumps(value), order))
    return spark.createDataFrame(rows, "node string, path string, value string, ord int")


def vcf_of_calls(calls: DataFrame, samples: list[str]) -> DataFrame:
    """One row per gene and place with the alternative alleles and a genotype per sample:
    its allele's number, 0 for the reference."""
    alts = calls.groupBy("gene", "pos", "ref").agg(F.array_sort(F.collect_set("alt")).alias("alts"))
    wide = calls.groupBy("gene", "pos").pivot("sample", samples).agg(F.first("alt"))
    genotypes = [F.when(F.col(f"`{s}`").isNull(), "0").otherwise(F.array_position("alts", F.col(f"`{s}`")).cast("string")).alias(s) for s in samples]
    return alts.join(wide, ["gene", "pos"]).select("gene", (F.col("pos") + 1).alias("pos"), "ref", F.array_join("alts", ",").alias("alt"), *genotypes)


def significant(value: Column, digits: int = 3) -> Column:
    """Rounded to significant digits, the integer part always whole."""
    places = F.lit(digits) - F.ceil(F.log10(F.greatest(F.abs(value), F.lit(1e-300))))
    scale = F.pow(F.lit(10.0), F.greatest(places, F.lit(0)))
    return F.when(value == 0, value).otherwise(F.round(value * scale) / scale)


def significant_of(value: float, digits: int = 3) -> float:
    """``significant`` for a number on the driver."""
    if value == 0 or not math.isfinite(value):
        return value
    return round(value, max(digits - math.ceil(math.log10(abs(value))), 0))
