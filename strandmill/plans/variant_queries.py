"""Variant calls of line items over a reference of nation names, and alignment membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.sequences import codon_table
from strandmill.operators import alignment, variants
from strandmill.plans.registry import query
from strandmill.plans.sequence_queries import _PARTS, _nuc, nucleotides, part_sequences

#: Parts (feature, start, end, strand): both strands, joined parts, and one past all calls.
FEATURES = [("fwd", 3, 63, 1), ("rev", 50, 110, -1), ("joined", 10, 26, 1), ("joined", 40, 60, 1), ("joined_rev", 70, 81, -1), ("joined_rev", 90, 103, -1), ("quiet", 140, 155, 1)]
_CODES = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in codon_table().items()) + "}"
_VARIANTS = f"""WITH ref AS (SELECT string_agg({_nuc('n_name')}, '' ORDER BY n_nationkey) AS s FROM nation),
  calls AS (SELECT l_orderkey AS sample, l_partkey % 120 + 1 AS pos, max(substr('ACGT', (l_suppkey % 4 + 1)::INT, 1)) AS alt FROM lineitem GROUP BY ALL),
  parts(feature, s, e, strand) AS (VALUES {', '.join(map(str, FEATURES))}),
  places AS (SELECT feature, strand, unnest(range(s, e)) AS spot FROM parts),
  ordered AS (SELECT feature, strand, spot, row_number() OVER (PARTITION BY feature ORDER BY spot * strand) - 1 AS k FROM places),
  read AS (SELECT feature, strand, spot, k // 3 AS codon, k, CASE WHEN strand < 0 THEN translate(substr(ref.s, spot + 1, 1), 'ACGT', 'TGCA') ELSE substr(ref.s, spot + 1, 1) END AS letter FROM ordered, ref),
  whole AS (SELECT *, count(*) OVER (PARTITION BY feature, codon) AS three FROM read),
  samples AS (SELECT DISTINCT sample, feature, codon FROM calls JOIN whole ON spot = pos - 1),
  built AS (SELECT s.sample, feature, codon, string_agg(letter, '' ORDER BY k) AS a,
      string_agg(CASE WHEN alt IS NULL THEN letter WHEN strand < 0 THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END, '' ORDER BY k) AS b
    FROM samples s JOIN whole w USING (feature, codon) LEFT JOIN calls c ON c.sample = s.sample AND c.pos = w.spot + 1 WHERE three = 3 GROUP BY ALL),
  changed AS (SELECT sample, feature, (codon + 1)::INT AS pos, {_CODES}[a] AS ref, {_CODES}[b] AS alt FROM built WHERE {_CODES}[a] <> {_CODES}[b])"""


def call_tables(spark, tables):
    """Calls, features and the reference."""
    rows = tables("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    calls = rows.select(F.lit("c").alias("chrom"), F.col("l_orderkey").alias("sample"), (F.col("l_partkey") % 120 + 1).alias("pos"), F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("alt"))
    names = tables("nation").select("n_nationkey", nucleotides(F.col("n_name")).alias("s"))
    reference = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "s"))), lambda r: r["s"]), "").alias("sequence")).select(F.lit("c").alias("chrom"), "sequence")
    features = spark.createDataFrame([("c", *part) for part in FEATURES], "chrom string, feature string, start long, end long, strand int")
    return calls, features, reference


@query("translate_variants", f"{_VARIANTS} SELECT sample, feature, pos, ref, alt FROM changed")
def translate_variants(spark, tables):
    return variants.translated_calls(*call_tables(spark, tables)).drop("chrom")


@query("unvaried_features", f"{_VARIANTS} SELECT DISTINCT feature FROM parts WHERE feature NOT IN (SELECT feature FROM changed)")
def unvaried_features(spark, tables):
    calls, features, reference = call_tables(spark, tables)
    return variants.unvaried_features(features, variants.translated_calls(calls, features, reference)).select("feature")


@query("mask_variants", "SELECT l_orderkey AS sample, l_partkey % 120 + 1 AS pos, substr('ACGT', (l_suppkey % 4 + 1)::INT, 1) AS alt FROM lineitem WHERE l_partkey % 120 NOT IN (SELECT s_nationkey * 4 FROM supplier)")
def mask_variants(spark, tables):
    calls, _, _ = call_tables(spark, tables)
    sites = tables("supplier").select(F.lit("c").alias("chrom"), (F.col("s_nationkey") * 4).alias("site"))
    return variants.unmasked_calls(calls, sites).select("sample", "pos", "alt")


def member_tables(tables):
    """Sequences with repeats, and an alignment of every third one with gaps between letters."""
    rows = part_sequences(tables)
    again = rows.where(F.col("id").cast("int") % 5 == 0)
    aligned = rows.where(F.col("id").cast("int") % 3 == 0).select("id", F.regexp_replace("sequence", "(..)", "$1-").alias("sequence"))
    changed = F.when(F.col("id").cast("int") % 2 == 0, F.concat("sequence", F.lit("A"))).otherwise(F.col("sequence"))
    return rows.unionByName(again), aligned.withColumn("sequence", changed)


@query("prune_aligned", f"SELECT id, s AS sequence FROM ({_PARTS}) WHERE id::INT % 3 <> 0")
def prune_aligned(spark, tables):
    return alignment.unaligned(*member_tables(tables))


@query("already_aligned", f"SELECT id, id::INT % 2 <> 0 AS same FROM ({_PARTS}) WHERE id::INT % 3 = 0")
def already_aligned(spark, tables):
    return alignment.already_aligned(*member_tables(tables))


@query("alignment_repeats", "SELECT p_partkey::VARCHAR AS id, 1 + (p_partkey % 5 = 0)::INT + (p_partkey % 3 = 0)::INT AS n FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0")
def alignment_repeats(spark, tables):
    return alignment.repeated_names(*member_tables(tables))


@query("unshared_names", "SELECT p_partkey::VARCHAR AS name, 'alignment' AS only_in FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey::VARCHAR, 'tree' FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part)")
def unshared_names(spark, tables):
    return alignment.unshared_names(part_sequences(tables), tables("customer").select(F.col("c_custkey").cast("string").alias("node")))
