"""Sequence sets around an existing alignment: repeats, members, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gap_free(sequence: Column) -> Column:
    """Upper-case letters without gaps: what an aligned sequence and its source share."""
    return F.upper(F.translate(sequence, "-", ""))


def collapsed(sequences: DataFrame, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    """One row per name; a name with two different sequences fails the job.

    Repeats are compared by length and two hashes of their letters as they are, so no
    sequence is held beside another. Null sequences count as empty; a null name is a name.
    """
    text = F.coalesce(F.col(sequence), F.lit(""))
    marked = sequences.select(F.col(id_column), text.alias(sequence), F.struct(F.length(text), F.xxhash64(text), F.md5(text.cast("binary"))).alias("_sm_print"))
    one = marked.groupBy(id_column).agg(F.min("_sm_print").alias("_sm_low"), F.max("_sm_print").alias("_sm_high"), F.first(sequence).alias(sequence))
    wrong = F.raise_error(F.concat(F.lit("one name has different sequences: "), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))
    return one.select(id_column, F.when(F.col("_sm_low") == F.col("_sm_high"), F.col(sequence)).otherwise(wrong).alias(sequence))


def unaligned(sequences: DataFrame, aligned: DataFrame, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    """Collapsed sequences whose names the alignment does not have: what is left to align."""
    return collapsed(sequences, id_column, sequence).join(aligned.select(id_column).distinct(), id_column, "left_anti")


def already_aligned(sequences: DataFrame, aligned: DataFrame, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    """(name, same): a report of names in both, and whether their letters agree without gaps."""
    ours = collapsed(sequences, id_column, sequence).select(id_column, F.xxhash64(gap_free(F.col(sequence))).alias("_sm_ours"), F.length(gap_free(F.col(sequence))).alias("_sm_n"))
    theirs = collapsed(aligned, id_column, sequence).select(id_column, F.xxhash64(gap_free(F.col(sequence))).alias("_sm_theirs"), F.length(gap_free(F.col(sequence))).alias("_sm_m"))
    same = (F.col("_sm_ours") == F.col("_sm_theirs")) & (F.col("_sm_n") == F.col("_sm_m"))
    return ours.join(theirs, id_column).select(id_column, same.alias("same"))


def repeated_names(*sets: DataFrame, id_column: str = "id") -> DataFrame:
    """(name, n) of names that occur more than once in all sets together."""
    every = sets[0].select(id_column)
    for other in sets[1:]:
        every = every.unionAll(other.select(id_column))
    return every.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unshared_names(sequences: DataFrame, tips: DataFrame, id_column: str = "id", tip_column: str = "node") -> DataFrame:
    """(name, only_in): names of an alignment that no tip of a tree has, and the other way round."""
    ours, theirs = sequences.select(F.col(id_column).alias("name")).distinct(), tips.select(F.col(tip_column).alias("name")).distinct()
    return ours.join(theirs, "name", "left_anti").withColumn("only_in", F.lit("alignment")).unionByName(theirs.join(ours, "name", "left_anti").withColumn("only_in", F.lit("tree")))
