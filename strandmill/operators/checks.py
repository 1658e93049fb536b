"""Checks of tables against themselves and against each other.

Every check has a report, a DataFrame of any size, and a form that fails or warns. Messages
name a bounded number of cases and how many there are; only those reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import merge

#: What to do about repeated ids.
POLICIES = ("error_first", "error_all", "warn", "silent")
#: Cases that a message names.
SHOWN = 100
#: The column that an index of each kind of sequence must have.
INDEX_COLUMNS = {"nuc": "invalid_nucleotides", "aa": "invalid_residues"}


def with_policy(df: DataFrame, id_column: str, policy: str = "error_first") -> DataFrame:
    """``df``, all rows kept, after a policy about repeated ids.

    ``error_first`` fails on one repeated id, ``error_all`` names them sorted, ``warn``
    prints them, ``silent`` does nothing. Null counts as an id of its own.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, expected one of {POLICIES}")
    if id_column not in df.columns:
        raise ValueError(f"id column {id_column!r} does not exist")
    if policy == "silent":
        return df
    repeated = merge.duplicate_ids(df, id_column)
    if policy == "error_first":
        first = repeated.select(id_column).limit(1).collect()
        if first:
            raise ValueError(f"id {first[0][0]!r} is repeated")
        return df
    message = _named(repeated.select(F.col(id_column).alias("case")))
    if message and policy == "error_all":
        raise ValueError(f"ids are repeated: {message}")
    if message:
        print(f"WARNING: ids are repeated: {message}")
    return df


def _named(cases: DataFrame) -> str:
    """The first of ``cases`` in order, and how many more there are; empty if there is none."""
    found = cases.orderBy("case").limit(SHOWN + 1).collect()
    text = ", ".join(repr(r[0]) for r in found[:SHOWN])
    return f"{text} and others, {cases.count()} in all" if len(found) > SHOWN else text


def check_index_kind(index: DataFrame, kind: str) -> DataFrame:
    """The index, which must have been made for sequences of a kind (``nuc`` or ``aa``)."""
    wanted = INDEX_COLUMNS[kind]
    if wanted not in index.columns:
        raise ValueError(f"the sequence index lacks {wanted!r}, it was not made for {kind!r} sequences")
    return index


def not_indexed(sequences: DataFrame, index: DataFrame, id_column: str = "id") -> DataFrame:
    """Ids of sequences that the index lacks, each once."""
    return sequences.select(id_column).subtract(index.select(id_column))


def name_differences(sequences: DataFrame, tips: DataFrame) -> DataFrame:
    """(side, name), each once: names that only the alignment or only the tree has.

    Both tables hold names in their first column. One union and one aggregate; a null name
    is a name like others.
    """
    rows = sequences.select(F.col(sequences.columns[0]).cast("string").alias("name"), F.lit("alignment").alias("side"))
    rows = rows.unionAll(tips.select(F.col(tips.columns[0]).cast("string"), F.lit("tree")))
    sides = rows.groupBy("name").agg(F.min("side").alias("side"), F.max("side").alias("_sm_other"))
    return sides.where(F.col("side") == F.col("_sm_other")).select("side", "name")


def check_names(sequences: DataFrame, tips: DataFrame) -> None:
    """Raise where the names of an alignment and of a tree's tips differ."""
    apart = name_differences(sequences, tips)
    sides = {side: _named(apart.where(F.col("side") == side).select(F.col("name").alias("case"))) for side in ("alignment", "tree")}
    if any(sides.values()):
        raise ValueError("; ".join(f"names only in the {side}: {names}" for side, names in sides.items() if names))


def author_info(metadata: DataFrame, tips: DataFrame, id_column: str, order: str, author: str = "authors", attributes: tuple[str, ...] = ("title", "journal", "paper_url")) -> DataFrame:
    """(author, n, attributes, contradictory) of authors of at least one tip of the tree.

    n counts rows of the table, whether or not in the tree. An attribute has its last value
    by ``order``, trimmed; contradictory lists the attributes with several values. Rows
    without an author are left out. ``tips`` holds ids in its first column.
    """
    present = [a for a in attributes if a in metadata.columns]
    rows = metadata.where(F.coalesce(F.col(author), F.lit("")) != "")
    ids = tips.select(F.col(tips.columns[0]).alias(id_column)).distinct().withColumn("_sm_tip", F.lit(True))
    trimmed = rows.join(ids, id_column, "left").select(author, order, "_sm_tip", *[F.trim(F.coalesce(F.col(a), F.lit(""))).alias(a) for a in present])
    ends = [e for a in present for e in (F.max_by(a, order).alias(a), F.min(a).alias(f"_sm_low_{a}"), F.max(a).alias(f"_sm_high_{a}"))]
    grouped = trimmed.groupBy(author).agg(F.count(F.lit(1)).alias("n"), F.max("_sm_tip").alias("_sm_tip"), *ends).where("_sm_tip")
    several = [F.when(F.col(f"_sm_low_{a}") != F.col(f"_sm_high_{a}"), a) for a in present]
    return grouped.select(author, "n", *present, (F.array_compact(F.array(*several)) if several else F.array().cast("array<string>")).alias("contradictory"))


def unique_keys(rows: DataFrame, column: str) -> DataFrame:
    """(key), each once: keys of a map column, or of the objects in a column of JSON text."""
    kind = dict(rows.dtypes)[column]
    keys = F.map_keys(column) if kind.startswith("map") else F.json_object_keys(column)
    return rows.select(F.explode(keys).alias("key")).distinct()


def unknown_fields(rows: DataFrame, column: str, fields: list[str]) -> list[str]:
    """Those of ``fields`` that no row has as a key."""
    found = {r[0] for r in unique_keys(rows, column).where(F.col("key").isin(*fields)).collect()} if fields else set()
    return [f for f in fields if f not in found]
