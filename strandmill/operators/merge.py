"""Merging metadata tables and sequence sets, and the joins around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Ids that occur more than once, with their number."""
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_metadata(tables: dict[str, tuple[DataFrame, str]], output_id: str | None = None, source_columns: str | None = None) -> DataFrame:
    """Full outer merge of any number of tables on their id columns.

    ``tables`` maps a name to (table, id column), in order. Per id and column the
    last non-empty value wins. ``source_columns`` such as ``in_{NAME}`` adds a
    0/1 column per table. Columns keep the order of their first appearance. One
    union and one aggregate, so one shuffle for any number of tables. An id that
    one table has twice fails the job.
    """
    names = list(tables)
    output_id = output_id or tables[names[0]][1]
    columns: list[str] = []
    for table, id_column in tables.values():
        for c in table.columns:
            if c != id_column and c == output_id:
                raise ValueError(f"column {c!r} clashes with the output id column")
            if c != id_column and c not in columns:
                columns.append(c)
    made = {name: source_columns.replace("{NAME}", name) for name in names} if source_columns else {}
    clash = set(made.values()) & {output_id, *columns}
    if clash:
        raise ValueError(f"source columns clash with others: {sorted(clash)}")
    tagged = [
        table.select(F.col(id_column).cast("string").alias(output_id), *[F.col(c).cast("string").alias(c) if c in table.columns and c != id_column else F.lit(None).cast("string").alias(c) for c in columns], F.lit(i).alias("_sm_order"))
        for i, (table, id_column) in enumerate(tables.values())
    ]
    rows = reduce(DataFrame.unionAll, tagged)
    last = [F.coalesce(F.max_by(F.col(c), F.when(F.col(c) != "", F.col("_sm_order"))), F.lit("")).alias(c) for c in columns]
    sources = [F.max((F.col("_sm_order") == i).cast("int")).alias(made[name]) for i, name in enumerate(names) if made]
    merged = rows.groupBy(output_id).agg(*last, *sources, _most_rows(len(names)))
    return _without_repeats(merged, output_id)


def _most_rows(tables: int) -> Column:
    """Most rows of a group that come from one table."""
    return F.greatest(*[F.count(F.when(F.col("_sm_order") == i, 1)) for i in range(tables)], F.lit(0).cast("long")).alias("_sm_rows")


def _without_repeats(merged: DataFrame, id_column: str) -> DataFrame:
    checked = F.when(F.col("_sm_rows") > 1, F.raise_error(F.concat(F.lit("id occurs more than once in one input: "), F.col(id_column)))).otherwise(F.col(id_column))
    return merged.withColumn(id_column, checked).drop("_sm_rows")


def merge_sequences(sets: list[DataFrame]) -> DataFrame:
    """(id, sequence) of all sets; for an id in several sets the last set wins. An id that
    one set has twice fails the job."""
    rows = reduce(DataFrame.unionAll, [s.select("id", "sequence", F.lit(i).alias("_sm_order")) for i, s in enumerate(sets)])
    merged = rows.groupBy("id").agg(F.max_by("sequence", "_sm_order").alias("sequence"), _most_rows(len(sets)))
    return _without_repeats(merged, "id")


def metadata_with_sequences(metadata: DataFrame, sequences: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined rows with upper-case sequence, metadata without one, sequences without metadata)."""
    found = sequences.select(F.col("id").alias(id_column), F.upper("sequence").alias("sequence"))
    return metadata.join(found, id_column), metadata.join(found, id_column, "left_anti"), found.join(metadata, id_column, "left_anti")


def annotate(df: DataFrame, annotations: DataFrame, id_column: str, warn: bool = False) -> DataFrame:
    """Overwrite fields by (id, field, value) rows; fields that do not exist are ignored and,
    where ``warn``, named.

    Annotations are small next to the table and are pivoted on its columns.
    """
    fields = [c for c in df.columns if c != id_column]
    if warn:
        for r in annotations.where(~F.col("field").isin(*fields)).select("field").distinct().orderBy("field").collect():
            print(f"WARNING: field {r[0]!r} does not exist")
    last = annotations.groupBy("id").agg(*[F.max_by("value", F.when(F.col("field") == c, F.col("line"))).alias(f"_sm_{c}") for c in fields])
    joined = df.join(last.withColumnRenamed("id", id_column), id_column, "left")
    return joined.select(id_column, *[F.coalesce(F.col(f"_sm_{c}"), F.col(c)).alias(c) for c in fields]).select(*df.columns)


def deep_merge(entries: DataFrame) -> DataFrame:
    """Merge nested attributes given as (node, path, value, ord): the last value of a
    path wins. Raises where one file has a value at a path under which another nests."""
    leaves = entries.groupBy("node", "path").agg(F.max_by("value", "ord").alias("value"))
    prefixes = leaves.select("node", F.explode(F.expr("transform(sequence(1, size(split(path, '[.]'))), i -> array_join(slice(split(path, '[.]'), 1, i), '.'))")).alias("prefix"), "path").where("prefix <> path")
    mixed = prefixes.join(leaves.select("node", F.col("path").alias("prefix"), "value"), ["node", "prefix"]).select("node", "prefix").limit(1).collect()
    if mixed:
        raise ValueError(f"node {mixed[0][0]!r}: {mixed[0][1]!r} is a value in one file and nested in another")
    return leaves


def common_and_missing(ids: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids that a list has too, ids that it lacks), each once; both hold ids in their first column."""
    name = ids.columns[0]
    one, two = ids.select(name), listed.select(F.col(listed.columns[0]).alias(name))
    return one.intersect(two), one.subtract(two)


def sequence_subset(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences whose id is in the list."""
    return sequences.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")


def samples_without(calls: DataFrame, dropped: DataFrame) -> DataFrame:
    """Long variant calls without the dropped samples."""
    return calls.join(dropped.select(F.col(dropped.columns[0]).alias("sample")).distinct(), "sample", "left_anti")
