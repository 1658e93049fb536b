"""Sequence kernels over texts turned into nucleotides."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import sequences
from strandmill.operators import clades, distance, frequencies, proximity
from strandmill.plans.registry import query

_LOW = "lower(coalesce(text, ''))"
#: A text's letters as nucleotides, in both dialects.
_NUC_FROM, _NUC_TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def _count(letters: str) -> str:
    return f"(length({_LOW}) - length(translate({_LOW}, '{letters}', '')))::BIGINT"


#: Width to which names of parts are filled; all of them are shorter.
WIDTH = 64


def nucleotides(column):
    """All letters of a text as a sequence of A, C, G and T; none for a null text."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[^a-z]", ""), _NUC_FROM, _NUC_TO)


def _nuc(column: str) -> str:
    return f"translate(regexp_replace(lower(coalesce({column}, '')), '[^a-z]', '', 'g'), '{_NUC_FROM}', '{_NUC_TO}')"


def _at(sequence: str, site: int) -> str:
    """SQL for a sequence with N at a 0-based site, where it has one."""
    return f"CASE WHEN length({sequence}) > {site} THEN substr({sequence}, 1, {site}) || 'N' || substr({sequence}, {site + 2}) ELSE {sequence} END"


_CLASSES = {"A": "a", "C": "c", "G": "g", "T": "t", "N": "n", "other_IUPAC": "rymkswhbvd", "-": "-", "?": "?"}


@query("index_nucleotide", "SELECT doc_id, length(" + _LOW + ")::BIGINT AS length, " + ", ".join(f'{_count(v)} AS "{k}"' for k, v in _CLASSES.items()) + f", length(translate({_LOW}, '{''.join(_CLASSES.values())}', ''))::BIGINT AS invalid_nucleotides FROM documents")
def index_nucleotide(spark, tables):
    return sequences.nucleotide_index(tables("documents"), "doc_id", "text")


@query("index_amino", f"SELECT doc_id, {_count('w')} AS \"W\", {_count('-')} AS \"-\", length(translate({_LOW}, 'acdefghiklmnpqrstvwy*x-', ''))::BIGINT AS invalid_residues FROM documents")
def index_amino(spark, tables):
    return sequences.amino_acid_index(tables("documents"), "doc_id", "text").select("doc_id", "W", "-", "invalid_residues")


@query("filter_length", f"SELECT doc_id FROM documents WHERE {_count('a')} + {_count('c')} + {_count('g')} + {_count('t')} BETWEEN 200 AND 900")
def filter_length(spark, tables):
    from strandmill.operators import predicates

    df = sequences.nucleotide_index(tables("documents"), "doc_id", "text")
    return predicates.kept(predicates.attributed(df, [predicates.min_length(200), predicates.max_length(900)])).select("doc_id")


@query("invalid_counts", f"SELECT invalid > 0 AS bad, count(*) AS n FROM (SELECT length(translate({_LOW}, '{''.join(_CLASSES.values())}', '')) AS invalid FROM documents) GROUP BY 1")
def invalid_counts(spark, tables):
    from strandmill.operators import predicates

    df = predicates.attributed(sequences.nucleotide_index(tables("documents"), "doc_id", "text"), [predicates.no_invalid()])
    return df.groupBy((~F.col("passed")).alias("bad")).agg(F.count(F.lit(1)).alias("n"))


@query("total_length", "SELECT sum(length(text))::BIGINT AS total, round(avg(length(text)), 6) AS mean FROM documents")
def total_length(spark, tables):
    df = sequences.nucleotide_index(tables("documents"), "doc_id", "text")
    return df.agg(F.sum("length").alias("total"), F.round(F.avg("length"), 6).alias("mean"))


@query("mask_sites", f"SELECT doc_id, CASE WHEN length(s) <= 5 THEN repeat('N', length(s)) ELSE 'NN' || substr(m, 3, length(s) - 5) || 'NNN' END AS masked FROM (SELECT doc_id, s, {_at('b', 77)} AS m FROM (SELECT doc_id, s, {_at('a', 30)} AS b FROM (SELECT doc_id, s, {_at('s', 5)} AS a FROM (SELECT doc_id, {_nuc('text')} AS s FROM documents))))")
def mask_sites(spark, tables):
    df = tables("documents").select("doc_id", nucleotides(F.col("text")).alias("s"))
    return df.select("doc_id", sequences.masked(F.col("s"), begin=2, end=3, sites=[5, 30, 77]).alias("masked"))


@query(
    "translate_codons",
    f"""WITH s AS (SELECT doc_id, {_nuc('text')} AS s FROM documents)
        SELECT doc_id, array_to_string([coalesce(MAP {{{', '.join(f"'{c}': '{a}'" for c, a in sequences.codon_table().items())}}}[substr(s, 3 * i + 1, 3)], 'X') FOR i IN range(length(s) // 3)], '') AS amino FROM s""",
)
def translate_codons(spark, tables):
    whole = tables("documents").select("doc_id", nucleotides(F.col("text")).alias("s"))
    codons = whole.select("doc_id", F.expr("substring(s, 1, length(s) - length(s) % 3)").alias("s"))
    return codons.select("doc_id", sequences.translated(F.col("s")).alias("amino"))


@query("reverse_feature", f"SELECT doc_id, reverse(translate(substr(s, 1, 6) || substr(s, 11), 'ACGT', 'TGCA')) AS feature FROM (SELECT doc_id, {_nuc('text')} AS s FROM documents)")
def reverse_feature(spark, tables):
    df = tables("documents").select("doc_id", nucleotides(F.col("text")).alias("s"))
    return df.select("doc_id", sequences.feature(F.col("s"), [(0, 6), (10, 2**31 - 1)], -1).alias("feature"))


_PARTS = f"SELECT p_partkey::VARCHAR AS id, rpad({_nuc('p_name')}, {WIDTH}, 'N') AS s FROM part"
_DIST = f"list_sum([(substr(f.s, i, 1) <> substr(c.s, i, 1) AND substr(f.s, i, 1) <> 'N' AND substr(c.s, i, 1) <> 'N')::INT FOR i IN range(1, {WIDTH + 1})])::BIGINT"


def part_sequences(tables):
    return tables("part").select(F.col("p_partkey").cast("string").alias("id"), F.rpad(nucleotides(F.col("p_name")), WIDTH, "N").alias("sequence"))


@query(
    "hamming_topk",
    f"WITH p AS ({_PARTS}), f AS (SELECT * FROM p WHERE id::INT % 20 = 0), c AS (SELECT *, length(s) - length(replace(s, 'N', '')) AS unknown FROM p WHERE id::INT % 20 <> 0), d AS (SELECT f.id AS focal, c.id AS id, {_DIST} AS distance, unknown::BIGINT AS unknown FROM f, c) SELECT * FROM d WHERE distance <= 16 QUALIFY row_number() OVER (PARTITION BY focal ORDER BY distance, unknown, id) <= 5",
)
def hamming_topk(spark, tables):
    rows = part_sequences(tables)
    focal = rows.where(F.col("id").cast("int") % 20 == 0)
    return proximity.neighbours(focal, rows, 5, max_distance=16)


@query("hamming_pairs", f"WITH p AS ({_PARTS}) SELECT f.id AS a, c.id AS b, {_DIST} AS distance FROM p f JOIN p c ON f.id::INT + 1 = c.id::INT")
def hamming_pairs(spark, tables):
    rows = part_sequences(tables)
    one, two = rows.toDF("a", "x"), rows.toDF("b", "y")
    return one.join(two, F.col("a").cast("int") + 1 == F.col("b").cast("int")).select("a", "b", sequences.hamming(F.col("x"), F.col("y")).alias("distance"))


@query("distance_weighted", f"WITH p AS ({_PARTS}) SELECT f.id AS first, c.id AS second, round(list_sum([CASE WHEN substr(f.s, i, 1) = substr(c.s, i, 1) OR substr(f.s, i, 1) = 'N' OR substr(c.s, i, 1) = 'N' THEN 0.0::DOUBLE WHEN i = 3 THEN 2.5::DOUBLE WHEN i = 5 AND substr(f.s, i, 1) = 'A' AND substr(c.s, i, 1) = 'G' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END FOR i IN range(1, {WIDTH + 1})]), 2) AS distance FROM p f JOIN p c ON f.id::INT + 1 = c.id::INT")
def distance_weighted(spark, tables):
    weights = distance.DistanceMap.from_json({"default": 1, "map": {"g": {"3": 2.5, "5": [{"from": "A", "to": "G", "weight": 4}]}}, "ignored_characters": ["N"]})
    rows = part_sequences(tables)
    one, two = rows.toDF("first", "a"), rows.toDF("second", "b")
    pairs = one.join(two, F.col("first").cast("int") + 1 == F.col("second").cast("int")).withColumn("gene", F.lit("g"))
    return distance.pair_distances(pairs, weights)


_GAPPED = f"""WITH p AS ({_PARTS}), q AS (SELECT f.id AS first, c.id AS second, replace(f.s, 'G', '-') AS a, replace(c.s, 'T', '-') AS b FROM p f JOIN p c ON f.id::INT + 1 = c.id::INT),
  l AS (SELECT first, second, i - 1 AS site, substr(a, i, 1) AS x, substr(b, i, 1) AS y FROM q, range(1, {WIDTH + 1}) t(i)),
  d AS (SELECT *, x = '-' OR y = '-' AS gap, CASE WHEN site % 3 = 0 AND site < 30 THEN 2.5::DOUBLE WHEN site = 4 AND x = 'A' AND y = 'C' THEN 7.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM l WHERE x <> y AND x <> 'N' AND y <> 'N'),
  e AS (SELECT first, second, max(w) AS w FROM (SELECT *, site - row_number() OVER (PARTITION BY first, second ORDER BY site) AS island FROM d WHERE gap) GROUP BY first, second, island UNION ALL SELECT first, second, w FROM d WHERE NOT gap)
  SELECT q.first, q.second, round(coalesce(sum(w), 0), 2) AS distance FROM q LEFT JOIN e USING (first, second) GROUP BY ALL"""


@query("distance_gap_runs", _GAPPED)
def distance_gap_runs(spark, tables):
    """Sequences with runs of gaps, each run one event of its greatest weight."""
    sites = {str(i + 1): 2.5 for i in range(0, 30, 3)} | {"5": [{"from": "A", "to": "C", "weight": 7}]}
    weights = distance.DistanceMap.from_json({"default": 1, "map": {"g": sites}, "ignored_characters": ["N"]})
    rows = part_sequences(tables)
    one = rows.select(F.col("id").alias("first"), F.translate("sequence", "G", "-").alias("a"))
    two = rows.select(F.col("id").alias("second"), F.translate("sequence", "T", "-").alias("b"))
    pairs = one.join(two, F.col("first").cast("int") + 1 == F.col("second").cast("int")).withColumn("gene", F.lit("g"))
    return distance.pair_distances(pairs, weights)


@query("distance_pairs_window", "SELECT p.o_orderkey AS first, n.o_orderkey AS second FROM orders p JOIN orders n ON year(n.o_orderdate) + (month(n.o_orderdate) - 1) / 12.0::DOUBLE + (day(n.o_orderdate) - 1) / 365.25::DOUBLE >= 1998.575 AND year(p.o_orderdate) + (month(p.o_orderdate) - 1) / 12.0::DOUBLE + (day(p.o_orderdate) - 1) / 365.25::DOUBLE < 1998.575")
def distance_pairs_window(spark, tables):
    from strandmill.functions.dates import coarse_decimal_year

    tips = tables("orders").select(F.col("o_orderkey").alias("node"), coarse_decimal_year(F.col("o_orderdate")).alias("num_date"))
    return distance.dated_pairs(tips, 1998.575)


@query("call_mutations", f"WITH p AS ({_PARTS}), q AS (SELECT f.id AS id, f.s AS a, c.s AS b FROM p f JOIN p c ON f.id::INT + 1 = c.id::INT) SELECT id, array_to_string(list_filter([CASE WHEN substr(a, i, 1) <> substr(b, i, 1) THEN substr(a, i, 1) || i || substr(b, i, 1) END FOR i IN range(1, {WIDTH + 1})], lambda x: x IS NOT NULL), ',') AS muts FROM q")
def call_mutations(spark, tables):
    rows = part_sequences(tables)
    one, two = rows.toDF("id", "a"), rows.toDF("other", "b")
    pairs = one.join(two, F.col("id").cast("int") + 1 == F.col("other").cast("int"))
    return pairs.select("id", F.array_join(sequences.mutations(F.col("a"), F.col("b")), ",").alias("muts"))


@query("apply_mutations", f"SELECT id, overlay AS changed FROM (SELECT id, substr(s, 1, 2) || 'T' || substr(s, 4, 4) || 'A' || substr(s, 9) AS overlay FROM ({_PARTS}))")
def apply_mutations(spark, tables):
    changes = F.array(F.struct(F.lit(3).alias("pos"), F.lit("T").alias("alt")), F.struct(F.lit(8).alias("pos"), F.lit("A").alias("alt")))
    return part_sequences(tables).select("id", sequences.applied(F.col("sequence"), changes).alias("changed"))


@query("correct_sequences", "SELECT p_partkey, regexp_replace(upper(p_name), '[^ACGTNRYMKSWBDHV-]', 'N', 'g') AS fixed FROM part")
def correct_sequences(spark, tables):
    return tables("part").select("p_partkey", sequences.corrected(F.col("p_name")).alias("fixed"))


@query("strip_reference_gaps", "SELECT p_partkey, list_aggregate(list_filter([CASE WHEN i % 3 <> 0 THEN substr(p_brand, i, 1) END FOR i IN range(1, length(p_brand) + 1)], lambda x: x IS NOT NULL), 'string_agg', '') AS stripped FROM part")
def strip_reference_gaps(spark, tables):
    reference = F.array_join(F.transform(F.split("p_brand", ""), lambda c, i: F.when((i + 1) % 3 == 0, "-").otherwise("A")), "")
    return tables("part").select("p_partkey", sequences.stripped_columns(F.col("p_brand"), reference).alias("stripped"))


@query("insertion_runs", "SELECT p_partkey, 2 AS place, substr(p_brand, 3, 2) AS letters FROM part")
def insertion_runs(spark, tables):
    reference = F.concat(F.lit("AA--"), F.repeat(F.lit("A"), F.length("p_brand") - 4))
    return tables("part").select("p_partkey", F.explode(sequences.insertions(F.col("p_brand"), reference)).alias("i")).select("p_partkey", "i.place", "i.letters")


@query("allele_frequencies", f"WITH l AS (SELECT i - 1 AS pos, substr(s, i, 1) AS letter FROM ({_PARTS}), range(1, {WIDTH + 1}) t(i)), c AS (SELECT pos, letter, count(*) AS n FROM l GROUP BY ALL) SELECT pos, letter, round(n / sum(n) OVER (PARTITION BY pos), 9) AS frequency FROM c QUALIFY n / sum(n) OVER (PARTITION BY pos) >= 0.05")
def allele_frequencies(spark, tables):
    return frequencies.allele_frequencies(part_sequences(tables), 0.05).withColumn("frequency", F.round("frequency", 9))


@query("informative_sites", f"WITH l AS (SELECT i - 1 AS pos, substr(s, i, 1) AS letter FROM ({_PARTS}), range(1, {WIDTH + 1}) t(i)), c AS (SELECT pos, letter, count(*) AS n FROM l WHERE letter NOT IN ('N', '-') GROUP BY ALL) SELECT pos FROM c GROUP BY pos HAVING count(*) >= 2 AND NOT (count(*) = 2 AND count(*) FILTER (WHERE n = 1) = 1)")
def informative_sites(spark, tables):
    return clades.informative_sites(part_sequences(tables))


@query("ambiguous_columns", f"SELECT i - 1 AS pos FROM ({_PARTS}), range(1, {WIDTH + 1}) t(i) GROUP BY i HAVING bool_and(substr(s, i, 1) = 'N')")
def ambiguous_columns(spark, tables):
    return clades.ambiguous_columns(part_sequences(tables))


@query("flanking_distances", f"""WITH p AS ({_PARTS}), q AS (SELECT f.id AS focal, c.id AS id, f.s AS a, c.s AS b FROM p f, p c WHERE f.id::INT % 20 = 0 AND c.id::INT % 20 <> 0),
  e AS (SELECT *, least(length(rtrim(a, 'N')), length(rtrim(b, 'N'))) AS last FROM q), d AS (SELECT focal, id, list_sum([(substr(a, i, 1) <> substr(b, i, 1))::INT FOR i IN range(1, last + 1)])::BIGINT AS distance, ({WIDTH} - length(rtrim(b, 'N')))::BIGINT AS unknown FROM e)
  SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY focal ORDER BY distance, unknown, id) <= 3""")
def flanking_distances(spark, tables):
    rows = part_sequences(tables)
    return proximity.neighbours(rows.where(F.col("id").cast("int") % 20 == 0), rows, 3, missing="flanking")


@query("all_distances", f"WITH p AS ({_PARTS}), d AS (SELECT f.id AS focal, c.id AS id, list_sum([(substr(f.s, i, 1) <> substr(c.s, i, 1))::INT FOR i IN range(1, {WIDTH + 1})])::BIGINT AS distance, ({WIDTH} - length(rtrim(c.s, 'N')))::BIGINT AS unknown FROM p f, p c WHERE f.id::INT % 20 = 0 AND c.id::INT % 20 <> 0) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY focal ORDER BY distance, unknown, id) <= 3")
def all_distances(spark, tables):
    rows = part_sequences(tables)
    return proximity.neighbours(rows.where(F.col("id").cast("int") % 20 == 0), rows, 3, missing="none")
