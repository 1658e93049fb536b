"""Variant calls: which amino acids they change, and calls at masked sites.

Calls are (chrom, sample, pos, alt), one letter at a 1-based place that differs from
the reference (chrom, sequence). Features are one row per part: (chrom, feature,
start, end, strand) with 0-based half-open places. Calls meet parts, and parts meet
the reference's letters, by equality of chromosome and bucket of places; a bucket of
``BUCKET`` letters bounds what lies in it, whatever the length of the genome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.sequences import codon_table, reverse_complement

#: Places per bucket of the interval joins.
BUCKET = 1024


def _letter(codon: Column) -> Column:
    """Amino acid of one codon: a gap for three gaps, X for what has no meaning."""
    codes = F.create_map(*[F.lit(x) for pair in (codon_table() | {"---": "-"}).items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.upper(codon)), F.lit("X"))


def _parts(features: DataFrame) -> DataFrame:
    """Parts with ``before``, the letters of a feature that are read before a part's first one:
    parts are read by place, from the last on the reverse strand."""
    size = F.col("end") - F.col("start")
    forward = F.sum(size).over(W.partitionBy("chrom", "feature").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    back = F.sum(size).over(W.partitionBy("chrom", "feature").orderBy(F.desc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    return features.select("chrom", "feature", "start", "end", "strand", F.coalesce(F.when(F.col("strand") < 0, back).otherwise(forward), F.lit(0)).alias("before"))


def _bucketed(parts: DataFrame) -> DataFrame:
    reach = F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))
    return parts.where("end > start").withColumn("bucket", F.explode(reach))


def reference_codons(reference: DataFrame, features: DataFrame) -> DataFrame:
    """(chrom, feature, codon, letters): codons of every feature from 0, in reading order.

    Letters that are left over at a feature's end, or lie past the reference's, make no codon.
    """
    chunks = reference.select("chrom", F.posexplode(F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{BUCKET}}}"), F.lit(0))).alias("bucket", "letters"))
    base = F.col("bucket") * BUCKET
    low, high = F.greatest(F.col("start"), base), F.least(F.col("end"), base + F.length("letters"))
    met = _bucketed(_parts(features)).join(chunks.withColumn("bucket", F.col("bucket").cast("long")), ["chrom", "bucket"]).where(high > low)
    piece = F.substring("letters", (low - base + 1).cast("int"), (high - low).cast("int"))
    place = F.col("before") + F.when(F.col("strand") < 0, F.col("end") - high).otherwise(low - F.col("start"))
    read = F.when(F.col("strand") < 0, reverse_complement(piece)).otherwise(piece)
    pieces = met.select("chrom", "feature", F.struct(place.alias("place"), read.alias("read")).alias("piece"))
    # A feature's letters meet in one row, which its own length bounds.
    whole = pieces.groupBy("chrom", "feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["read"]), "").alias("letters"))
    return whole.select("chrom", "feature", F.posexplode(F.regexp_extract_all("letters", F.lit("(?s).{3}"), F.lit(0))).alias("codon", "letters"))


def translated_calls(calls: DataFrame, features: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, sample, feature, pos, ref, alt): amino acids, counted from 1, that calls change.

    Calls are grouped by sample, feature and codon, so several calls of one codon act
    together; all letters without a call are the reference's. Synonymous codons drop
    out. Of several calls of one place the greatest letter counts; calls outside all
    features, or in a codon that is not whole, change nothing. Null samples are one sample.
    Samples are dealt over as many numbers as there are partitions, and parts and codons,
    which a genome bounds, are repeated for each: most calls share one chromosome and bucket.
    """
    deals = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.xxhash64("sample"), F.lit(deals)).cast("int").alias("deal")
    every = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")
    found = calls.select("chrom", "sample", (F.col("pos") - 1).cast("long").alias("at"), "alt").where("at >= 0").withColumn("bucket", F.floor(F.col("at") / BUCKET)).select("*", deal)
    inside = found.join(_bucketed(_parts(features)).select("*", every), ["chrom", "bucket", "deal"]).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    place = F.col("before") + F.when(F.col("strand") < 0, F.col("end") - 1 - F.col("at")).otherwise(F.col("at") - F.col("start"))
    keyed = inside.select("chrom", "sample", "feature", "strand", F.floor(place / 3).cast("int").alias("codon"), (place % 3).alias("third"), "alt")
    touched = keyed.groupBy("chrom", "sample", "feature", "codon").agg(F.min("strand").alias("strand"), *[F.max(F.when(F.col("third") == i, F.col("alt"))).alias(f"alt{i}") for i in range(3)])
    both = touched.select("*", deal).join(reference_codons(reference, features).select("*", every), ["chrom", "feature", "codon", "deal"])
    letters = [F.when(F.col("strand") < 0, reverse_complement(F.col(f"alt{i}"))).otherwise(F.col(f"alt{i}")) for i in range(3)]
    made = F.concat(*[F.coalesce(letter, F.substring("letters", i + 1, 1)) for i, letter in enumerate(letters)])
    changed = both.select("chrom", "sample", "feature", (F.col("codon") + 1).alias("pos"), _letter(F.col("letters")).alias("ref"), _letter(made).alias("alt"))
    return changed.where("ref <> alt")


def unvaried_features(features: DataFrame, changes: DataFrame) -> DataFrame:
    """(chrom, feature) of features in which no sample has a changed amino acid: a report."""
    return features.select("chrom", "feature").distinct().join(changes.select("chrom", "feature").distinct(), ["chrom", "feature"], "left_anti")


def unmasked_calls(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls without those at masked sites (chrom, site), whose 0-based places are as in a BED file."""
    return calls.join(sites.select("chrom", (F.col("site") + 1).alias("pos")).distinct(), ["chrom", "pos"], "left_anti").select(*calls.columns)
