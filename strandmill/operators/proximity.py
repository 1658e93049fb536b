"""Nearest neighbours of focal sequences by Hamming distance.

Sequences are packed into words of 64 sites: two planes of bits for the letter, one
that marks known letters (A, C, G, T) and one that marks the span between the first
and the last of them. Differences are exclusive ors and bit counts inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Different focal sequences that one block compares with a slice of the context.
BLOCK_ROWS = 4096
#: Words up to which a comparison is written out, which compiles to a few instructions each;
#: longer sequences loop over words by array functions, which Spark interprets.
UNROLLED = 12


def _letters(sequence: Column) -> Column:
    return F.regexp_replace(F.upper(sequence), "(?s)[^ACGT]", "N")


def packed(sequence: Column) -> Column:
    """array<struct<low, high, known, span>>, one struct of longs for 64 sites."""
    letters = _letters(sequence)
    lead = F.length(letters) - F.length(F.ltrim(letters, F.lit("N")))
    inner = F.length(F.trim(letters, F.lit("N")))
    span = F.concat(F.repeat(F.lit("0"), lead), F.repeat(F.lit("1"), inner), F.repeat(F.lit("0"), F.length(letters) - lead - inner))
    planes = [F.translate(letters, "ACGTN", "01010"), F.translate(letters, "ACGTN", "00110"), F.translate(letters, "ACGTN", "11110"), span]
    # The negative base makes words signed, as longs are.
    words = [F.transform(F.regexp_extract_all(p, F.lit(".{1,64}"), F.lit(0)), lambda w: F.conv(w, 2, -10).cast("long")) for p in planes]
    zipped = F.arrays_zip(*[w.alias(name) for w, name in zip(words, ("low", "high", "known", "span"), strict=True)])
    return zipped


def differences(a: Column, b: Column, missing: str = "all", words: int | None = None) -> Column:
    """Sites at which two packed sequences of ``words`` words, if known, differ. ``missing`` says where unknown letters do
    not count: ``none`` (they count as one more letter), ``all``, or ``flanking`` (outside
    both spans)."""

    def bits(x: Column, y: Column) -> Column:
        letters = x["low"].bitwiseXOR(y["low"]).bitwiseOR(x["high"].bitwiseXOR(y["high"]))
        if missing == "all":
            return letters.bitwiseAND(x["known"]).bitwiseAND(y["known"])
        any_letter = letters.bitwiseOR(x["known"].bitwiseXOR(y["known"]))
        return any_letter.bitwiseAND(x["span"]).bitwiseAND(y["span"]) if missing == "flanking" else any_letter

    if missing not in ("none", "all", "flanking"):
        raise ValueError(f"no rule for missing letters is called {missing!r}")
    if words is not None and words <= UNROLLED:
        return reduce(Column.__add__, [F.coalesce(F.bit_count(bits(F.get(a, F.lit(i)), F.get(b, F.lit(i)))), F.lit(0)) for i in range(words)], F.lit(0)).cast("long")
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(bits(x, y))), F.lit(0).cast("long"), lambda total, n: total + n)


def neighbours(focal: DataFrame, context: DataFrame, k: int, max_distance: int | None = None, missing: str = "all", id_column: str = "id") -> DataFrame:
    """(focal, id, distance, unknown): the k nearest context rows per focal row.

    Ties at the last place go to fewer unknown letters, then to the name. Context rows
    that are focal are left out. Rows of equal letters are one class: each focal class
    meets, of each context class, the k first names, as no later one can be among the k
    nearest; what it finds holds for all its rows. Classes are as many as there are
    different sequences, whatever the number of copies. Focal classes are dealt into
    blocks and context rows into slices, and each block meets each slice in one
    join by both numbers, so that neither side is held whole anywhere. Spark ranks
    within each task first, so at most k rows per focal class and task are shuffled on.
    Raises where two sequences differ in length.
    """
    spark = focal.sparkSession
    letters, length = _letters(F.col("sequence")), F.length("sequence")
    own = focal.select(F.col(id_column).alias("focal"), letters.alias("_sm_a"), length.alias("_sm_m"))
    classes = own.select("_sm_a", "_sm_m").distinct()
    size = classes.agg(F.count(F.lit(1)), F.max("_sm_m")).first()
    blocks, words = max(1, -(-size[0] // BLOCK_ROWS)), -(-(size[1] or 0) // 64)
    # Pairs grow with the product of both sides, which sizes do not show: partitions stay as many as asked for.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, 4 * parts // blocks)
    rows = context.join(focal.select(id_column).distinct(), id_column, "left_anti").select(id_column, letters.alias("_sm_b"), length.alias("_sm_n"))
    first = F.row_number().over(W.partitionBy("_sm_b", "_sm_n").orderBy(id_column))
    rows = rows.withColumn("_sm_copy", first).where(F.col("_sm_copy") <= k)
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = classes.select("_sm_a", "_sm_m", packed(F.col("_sm_a")).alias("a"), deal(blocks, "_sm_a", "_sm_m").alias("block"), every(slices).alias("slice"))
    two = rows.select(id_column, packed(F.col("_sm_b")).alias("b"), "_sm_n", deal(slices, id_column).alias("slice"), every(blocks).alias("block"))
    unknown = F.col("_sm_n") - F.aggregate("b", F.lit(0).cast("long"), lambda total, w: total + F.bit_count(w["known"]))
    two = two.withColumn("unknown", unknown)
    distance = F.when(F.col("_sm_m") == F.col("_sm_n"), differences(F.col("a"), F.col("b"), missing, words)).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("long"))
    one, two = (side.repartition(parts, "block", "slice") for side in (one, two))
    met = one.join(two, ["block", "slice"]).select("_sm_a", "_sm_m", id_column, distance.alias("distance"), "unknown")
    near = met if max_distance is None else met.where(F.col("distance") <= max_distance)
    ranked = near.withColumn("_sm_rank", F.row_number().over(W.partitionBy("_sm_a", "_sm_m").orderBy("distance", "unknown", id_column)))
    return own.join(ranked.where(F.col("_sm_rank") <= k), ["_sm_a", "_sm_m"]).select("focal", id_column, "distance", "unknown")


def matches(found: DataFrame, id_column: str = "id") -> DataFrame:
    """Distinct context ids of all focal rows, sorted."""
    return found.select(id_column).distinct().orderBy(id_column)
