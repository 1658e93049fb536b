"""Readers and writers through files, and operators on trees, titers and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import sequences
from strandmill.operators import clades, curate, distance, export, frequencies, merge, predicates, titers, tree
from strandmill.plans.registry import query
from strandmill.plans.sequence_queries import WIDTH, nucleotides
from strandmill.plans.sequence_queries import _PARTS as PARTS
from strandmill.plans.tree_queries import _TREE as TREE
from strandmill.plans.tree_queries import heap_nodes
from strandmill.sources import readers, writers


def _lines(df, tables, name):
    """A text file of the rows of ``df`` (ord, value), in order."""
    path = tables.fresh(name)
    df.orderBy("ord").select("value").coalesce(1).write.text(path)
    return path


@query("file_tsv", "SELECT c_custkey::VARCHAR AS strain, c_name || '\"x' AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def file_tsv(spark, tables):
    path = tables.fresh("customers.tsv")
    df = tables("customer").select(F.concat("c_name", F.lit('"x')).alias("name"), F.col("c_custkey").cast("string").alias("strain"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    writers.write_table(df, path)
    found, key = readers.read_metadata(spark, path)
    return found.select(key, "name", "segment")


@query("file_ndjson", "SELECT p_partkey AS k, p_name AS name, p_retailprice::DOUBLE AS price FROM part")
def file_ndjson(spark, tables):
    path = tables.fresh("parts.ndjson.gz")
    writers.write_ndjson(tables("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("double").alias("price")), path)
    return readers.read_ndjson(spark, path, "k long, name string, price double")


@query("file_fasta", f"SELECT id, s AS sequence FROM ({PARTS})")
def file_fasta(spark, tables):
    path = tables.fresh("parts.fasta")
    df = tables("part").select(F.col("p_partkey").cast("string").alias("id"), F.rpad(nucleotides(F.col("p_name")), WIDTH, "N").alias("sequence"))
    writers.write_fasta(df, path)
    return readers.read_fasta(spark, path).select("id", "sequence")


@query("file_genbank", f"SELECT 'g' || id || '.1' AS id, 'part ' || id AS description, s AS sequence FROM ({PARTS})")
def file_genbank(spark, tables):
    """Flat files of parts, with numbered sequence lines."""
    path = tables.fresh("parts.gb")
    number = F.col("p_partkey").cast("string")
    letters = F.lower(F.regexp_replace(F.rpad(nucleotides(F.col("p_name")), WIDTH, "N"), "(.{10})", "$1 "))
    text = F.concat(F.lit("LOCUS       g"), number, F.lit(" 64 bp DNA\nDEFINITION  part\n            "), number, F.lit("\nACCESSION   g"), number, F.lit("\nVERSION     g"), number, F.lit(".1\nFEATURES             Location/Qualifiers\nORIGIN\n        1 "), letters, F.lit("\n//"))
    tables("part").select(text.alias("value")).write.text(path)
    return readers.read_sequences(spark, path, kind="genbank", repeats="error")


@query("file_order", "SELECT k - 1 AS row, strain, name FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_custkey::VARCHAR AS strain, c_name AS name FROM customer) WHERE k % 3 = 0")
def file_order(spark, tables):
    """Every third line of a file with its number, after writing the kept lines in order again."""
    path, again = tables.fresh("ordered.tsv"), tables.fresh("kept.tsv")
    rows = tables("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("strain"), F.col("c_name").alias("name"))
    writers.write_in_order(rows, path, "c_custkey")
    lines, _ = readers.read_metadata(spark, path)
    kept = readers.numbered(lines).where(F.col("row") % 3 == 2)
    writers.write_in_order(kept, again)
    back, _ = readers.read_metadata(spark, again)
    return readers.numbered(back).select((F.col("row") * 3 + 2).alias("row"), "strain", "name")


@query("file_vcf", "WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'one' AS sample, '1' AS chrom, k - 1 AS pos, 'A' AS ref, CASE k % 3 WHEN 1 THEN 'T' ELSE 'G' END AS alt FROM s WHERE k % 3 > 0 UNION ALL SELECT 'two', '1', k - 1, 'A', 'T' FROM s WHERE k % 2 = 1")
def file_vcf(spark, tables):
    k = F.col("s_suppkey")
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "one", "two"])
    rows = tables("supplier").select(k.alias("ord"), F.concat_ws("\t", F.lit("1"), k.cast("string"), F.lit("."), F.lit("A"), F.lit("T,G"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), (k % 3).cast("string"), F.concat((k % 2).cast("string"), F.lit("|0"))).alias("value"))
    return readers.read_vcf(spark, _lines(spark.createDataFrame([(-2, "##fileformat=VCFv4.2"), (-1, head)], "ord long, value string").unionByName(rows), tables, "calls.vcf"))


@query("file_bed", "SELECT DISTINCT unnest(range(n_nationkey * 10, n_nationkey * 10 + n_regionkey * 6)) AS site FROM nation")
def file_bed(spark, tables):
    start = F.col("n_nationkey") * 10
    rows = tables("nation").select(F.col("n_nationkey").alias("ord"), F.concat_ws("\t", F.lit("chrom"), start.cast("string"), (start + F.col("n_regionkey") * 6).cast("string")).alias("value"))
    return readers.read_bed_sites(spark, _lines(spark.createDataFrame([(-1, "track name=x")], "ord long, value string").unionByName(rows), tables, "mask.bed"))


@query("file_sites", "SELECT DISTINCT n_nationkey + 6 AS site FROM nation")
def file_sites(spark, tables):
    return readers.read_sites(spark, _lines(tables("nation").select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") + 7).cast("string").alias("value")), tables, "sites.txt"))


@query("file_ids", "SELECT n_name AS id FROM nation")
def file_ids(spark, tables):
    rows = tables("nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.when(F.col("n_regionkey") == 0, "# note\n\n").otherwise(""), "n_name", F.lit("  # why")).alias("value"))
    return readers.read_id_list(spark, _lines(rows, tables, "ids.txt"))


@query("file_priorities", "SELECT n_name AS id, n_regionkey + 0.5::DOUBLE AS priority FROM nation")
def file_priorities(spark, tables):
    rows = tables("nation").select(F.col("n_nationkey").alias("ord"), F.concat_ws("\t", "n_name", (F.col("n_regionkey") + 0.5).cast("string")).alias("value"))
    return readers.read_priorities(spark, _lines(rows, tables, "priorities.tsv"))


@query("clade_sums", f"{TREE} SELECT anc::VARCHAR AS node, round(sum(n.len), 6) AS frequency FROM up JOIN n ON \"desc\" = node WHERE is_tip GROUP BY 1")
def clade_sums(spark, tables):
    nodes = heap_nodes(tables)
    tips = nodes.where("is_tip").select(F.col("node").alias("tip"), F.lit(2000.0).alias("pivot"), F.col("branch_length").alias("frequency"))
    return frequencies.clade_frequencies(tips, nodes).select("node", F.round("frequency", 6).alias("frequency"))


@query("site_frequencies", f"WITH p AS ({PARTS}), l AS (SELECT id AS tip, i - 1 AS pos, substr(s, i, 1) AS base FROM p, range(1, {WIDTH + 1}) t(i)), v AS (SELECT pos FROM l GROUP BY 1 HAVING count(DISTINCT base) > 1) SELECT pos, base, round(sum(1.0::DOUBLE / (SELECT count(*) FROM part)), 9) AS frequency FROM l JOIN v USING (pos) GROUP BY ALL")
def site_frequencies(spark, tables):
    rows = tables("part").select(F.col("p_partkey").cast("string").alias("tip"), F.rpad(nucleotides(F.col("p_name")), WIDTH, "N").alias("s"))
    letters = rows.select("tip", F.posexplode(F.split("s", "")).alias("pos", "base"))
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    each = rows.crossJoin(F.broadcast(total)).select("tip", F.lit(2000.0).alias("pivot"), (1 / F.col("all")).alias("frequency"))
    return frequencies.site_frequencies(each, letters).select("pos", "base", F.round("frequency", 9).alias("frequency"))


@query("branch_mutations", f"{TREE}, s AS (SELECT c_custkey + 1 AS node, c_name AS q FROM customer) SELECT n.node::VARCHAR AS node, 'g' AS gene, array_to_string(list_filter([CASE WHEN substr(p.q, i, 1) <> substr(s.q, i, 1) THEN substr(p.q, i, 1) || i || substr(s.q, i, 1) END FOR i IN range(1, length(s.q) + 1)], lambda x: x IS NOT NULL), ',') AS mutations FROM n JOIN s ON s.node = n.node JOIN s p ON p.node = n.parent")
def branch_mutations(spark, tables):
    named = tables("customer").select((F.col("c_custkey") + 1).cast("string").alias("node"), F.lit("g").alias("gene"), F.col("c_name").alias("sequence"))
    return clades.branch_mutations(heap_nodes(tables), named).withColumn("mutations", F.array_join("mutations", ","))


@query("cumulative_effects", f"{TREE} SELECT \"desc\"::VARCHAR AS node, round(sum(a.len), 6) AS total FROM up JOIN n a ON anc = a.node GROUP BY 1")
def cumulative_effects(spark, tables):
    nodes = heap_nodes(tables)
    return titers.cumulative_effect(nodes, nodes.select("node", F.col("branch_length").alias("effect"))).select("node", F.round("total", 6).alias("total"))


@query("repeated_names", "SELECT c_mktsegment AS node, count(*) AS count FROM customer GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, tables):
    return tree.duplicate_names(tables("customer").select(F.col("c_mktsegment").alias("node")))


@query("repeated_mutations", "SELECT l_orderkey AS node, l_returnflag AS gene, l_linestatus AS pos, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_mutations(spark, tables):
    return clades.repeated_mutations(tables("lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_returnflag").alias("gene"), F.col("l_linestatus").alias("pos")))


@query("root_states", "SELECT 'g' AS gene, i AS pos, substr(c_name, i, 1) AS state FROM customer, range(1, length(c_name) + 1) t(i) WHERE c_custkey = 0")
def root_states(spark, tables):
    named = tables("customer").select((F.col("c_custkey") + 1).cast("string").alias("node"), F.lit("g").alias("gene"), F.col("c_name").alias("sequence"))
    return clades.root_reference(heap_nodes(tables), named)


@query("distance_to_root", f"{TREE}, s AS (SELECT c_custkey + 1 AS node, c_name AS q FROM customer), r AS (SELECT q FROM s WHERE node = 1) SELECT '1' AS first, s.node::VARCHAR AS second, round(list_sum([(substr(r.q, i, 1) <> substr(s.q, i, 1))::INT FOR i IN range(1, length(s.q) + 1)])::DOUBLE, 2) AS distance FROM s, r WHERE s.node > 0")
def distance_to_root(spark, tables):
    named = tables("customer").select((F.col("c_custkey") + 1).cast("string").alias("node"), F.lit("g").alias("gene"), F.col("c_name").alias("sequence"))
    return distance.to_root(heap_nodes(tables), named, distance.DistanceMap())


@query("distance_to_ancestor", f"{TREE}, s AS (SELECT c_custkey + 1 AS node, c_name AS q FROM customer) SELECT p.node::VARCHAR AS first, s.node::VARCHAR AS second, round(list_sum([(substr(p.q, i, 1) <> substr(s.q, i, 1))::INT FOR i IN range(1, length(s.q) + 1)])::DOUBLE, 2) AS distance FROM n JOIN s ON s.node = n.node JOIN s p ON p.node = n.parent")
def distance_to_ancestor(spark, tables):
    named = tables("customer").select((F.col("c_custkey") + 1).cast("string").alias("node"), F.lit("g").alias("gene"), F.col("c_name").alias("sequence"))
    above = heap_nodes(tables).where("parent is not null").select("node", F.col("parent").alias("ancestor"))
    return distance.to_ancestor(above, named, distance.DistanceMap())


@query("path_between", f"{TREE}, a AS (SELECT anc FROM up WHERE \"desc\" = 90), b AS (SELECT anc FROM up WHERE \"desc\" = 101) SELECT anc::VARCHAR AS node FROM (SELECT anc FROM a WHERE anc NOT IN (SELECT anc FROM b) UNION ALL SELECT anc FROM b WHERE anc NOT IN (SELECT anc FROM a)) WHERE anc NOT IN (90, 101)")
def path_between(spark, tables):
    return tree.path_between(tree.closure(heap_nodes(tables)), "90", "101")


@query("titer_restricted", "WITH t AS (SELECT 'v' || l_partkey % 50 AS test, 'v' || l_suppkey % 40 AS ref FROM lineitem) SELECT test, ref, count(*) AS n FROM t WHERE test IN (SELECT 'v' || n_nationkey FROM nation) AND ref IN (SELECT 'v' || n_nationkey FROM nation) GROUP BY ALL")
def titer_restricted(spark, tables):
    rows = tables("lineitem").select(F.concat(F.lit("v"), F.col("l_partkey") % 50).alias("test"), F.concat(F.lit("v"), F.col("l_suppkey") % 40).alias("ref"))
    strains = tables("nation").select(F.concat(F.lit("v"), "n_nationkey"))
    return titers.restricted(rows, strains).groupBy("test", "ref").agg(F.count(F.lit(1)).alias("n"))


@query("titer_strain_counts", "WITH t AS (SELECT 'v' || l_partkey % 50 AS test, 'v' || l_suppkey % 40 AS ref FROM lineitem) SELECT strain, count(*) AS n FROM (SELECT test AS strain FROM t UNION ALL SELECT ref FROM t WHERE ref <> test) GROUP BY 1")
def titer_strain_counts(spark, tables):
    return titers.strain_counts(tables("lineitem").select(F.concat(F.lit("v"), F.col("l_partkey") % 50).alias("test"), F.concat(F.lit("v"), F.col("l_suppkey") % 40).alias("ref")))


@query("titer_tree_design", f"{TREE}, t AS (SELECT node AS test, node - 1 AS ref FROM n WHERE is_tip AND node - 1 IN (SELECT node FROM n WHERE is_tip)), b AS (SELECT test, ref, anc FROM t JOIN up ON \"desc\" = test WHERE steps > 0 UNION ALL SELECT test, ref, anc FROM t JOIN up ON \"desc\" = ref WHERE steps > 0) SELECT test::VARCHAR AS test, ref::VARCHAR AS ref, 'x' AS serum, 'branch:' || anc AS feature FROM b GROUP BY ALL HAVING count(*) = 1 UNION ALL SELECT test::VARCHAR, ref::VARCHAR, 'x', 'potency:' || ref || '|x' FROM t UNION ALL SELECT test::VARCHAR, ref::VARCHAR, 'x', 'avidity:' || test FROM t")
def titer_tree_design(spark, tables):
    nodes = heap_nodes(tables)
    tips = nodes.where("is_tip").select(F.col("node").alias("test"))
    refs = tips.select(F.col("test").alias("ref"), (F.col("test").cast("int") + 1).cast("string").alias("test"))
    return titers.tree_design(tips.join(refs, "test").select("test", "ref", F.lit("x").alias("serum")), tree.closure(nodes))


def sparse_measurements(nodes):
    """Pairs of every 24th tip and one 72 places further, on the customer tree."""
    key = F.col("node").cast("long")
    tips = nodes.where("is_tip").where(key % 24 == 0)
    refs = tips.select(F.col("node").alias("ref"), (key + 72).cast("string").alias("test"))
    return tips.select(F.col("node").alias("test")).join(refs, "test").select("test", "ref", F.lit("x").alias("serum"))


@query("titer_branch_groups", f"{TREE}, t AS (SELECT node AS test, node - 72 AS ref FROM n WHERE is_tip AND node % 24 = 0 AND node - 72 IN (SELECT node FROM n WHERE is_tip)), b AS (SELECT anc, test FROM t JOIN up ON \"desc\" = test UNION ALL SELECT anc, test FROM t JOIN up ON \"desc\" = ref), s AS (SELECT anc, test FROM b GROUP BY ALL HAVING count(*) = 1), g AS (SELECT anc, string_agg(test, ',' ORDER BY test) AS of FROM s WHERE anc <> 1 AND anc IN (SELECT node FROM n WHERE NOT is_tip) GROUP BY 1) SELECT anc::VARCHAR AS node, min(anc::VARCHAR) OVER (PARTITION BY of) AS \"group\" FROM g")
def titer_branch_groups(spark, tables):
    nodes = heap_nodes(tables)
    return titers.branch_groups(nodes, sparse_measurements(nodes))


@query("titer_pair_counts", "SELECT l_returnflag AS change, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def titer_pair_counts(spark, tables):
    return titers.pair_counts(tables("lineitem").select(F.col("l_returnflag").alias("change")))


@query("sequence_subset", f"SELECT id FROM ({PARTS}) WHERE id IN (SELECT l_partkey::VARCHAR FROM lineitem)")
def sequence_subset(spark, tables):
    rows = tables("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("sequence"))
    return merge.sequence_subset(rows, tables("lineitem").select(F.col("l_partkey").cast("string"))).select("id")


@query("samples_without", "SELECT l_orderkey AS sample, l_linenumber AS pos FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def samples_without(spark, tables):
    calls = tables("lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("pos"))
    return merge.samples_without(calls, tables("orders").where("o_orderstatus = 'F'").select("o_orderkey"))


@query("vcf_rows", "WITH c AS (SELECT l_linenumber AS pos, l_returnflag AS alt, 's' || l_orderkey % 2 AS sample FROM lineitem), f AS (SELECT pos, sample, min(alt) AS alt FROM c GROUP BY ALL), a AS (SELECT pos, list_sort(list_distinct(list(alt))) AS alts FROM f GROUP BY 1) SELECT 'g' AS gene, pos + 1 AS pos, 'X' AS ref, array_to_string(alts, ',') AS alt, coalesce(list_position(alts, (SELECT alt FROM f WHERE f.pos = a.pos AND sample = 's0')), 0)::VARCHAR AS s0, coalesce(list_position(alts, (SELECT alt FROM f WHERE f.pos = a.pos AND sample = 's1')), 0)::VARCHAR AS s1 FROM a")
def vcf_rows(spark, tables):
    calls = tables("lineitem").select(F.lit("g").alias("gene"), F.col("l_linenumber").alias("pos"), F.lit("X").alias("ref"), F.col("l_returnflag").alias("alt"), F.concat(F.lit("s"), F.col("l_orderkey") % 2).alias("sample"))
    one = calls.groupBy("gene", "pos", "ref", "sample").agg(F.min("alt").alias("alt"))
    return writers.vcf_of_calls(one, ["s0", "s1"])


@query("pretty_alignment", "SELECT p_partkey, upper(p_name) AS sequence, p_brand AS id, replace(p_type, '-', 'N') AS filled FROM part")
def pretty_alignment(spark, tables):
    upper, name = sequences.pretty_alignment(F.col("p_name"), F.concat(F.lit("_R_"), "p_brand"))
    return tables("part").select("p_partkey", upper.alias("sequence"), name.alias("id"), sequences.gaps_as_unknown(F.col("p_type")).alias("filled"))


@query("geo_places", "SELECT 'segment' AS resolution, c_mktsegment AS value, c_mktsegment IN ('BUILDING', 'MACHINERY') AS known FROM customer GROUP BY ALL")
def geo_places(spark, tables):
    places = {("segment", "building"): (1.0, 2.0), ("segment", "machinery"): (3.0, 4.0)}
    found, missing = export.geo_resolutions(tables("customer").select(F.col("c_mktsegment").alias("segment")), ["segment"], places)
    rows = [(r["key"], value, True) for r in found for value in r["demes"]] + [(key, value, False) for key, value in missing]
    return spark.createDataFrame(rows, "resolution string, value string, known boolean")


@query("value_types", "SELECT * FROM (VALUES ('balance', 'continuous'), ('flag', 'boolean'), ('segment', 'categorical')) v(attribute, kind)")
def value_types(spark, tables):
    df = tables("customer").select(F.col("c_acctbal").cast("string").alias("balance"), F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no").alias("flag"), F.col("c_mktsegment").alias("segment"))
    return spark.createDataFrame(sorted(export.value_types(df, df.columns).items()), "attribute string, kind string")


@query("significant_digits", "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0 ELSE round(c_acctbal::DOUBLE * s) / s END AS shown FROM (SELECT *, pow(10.0::DOUBLE, greatest(3 - ceil(log10(abs(c_acctbal::DOUBLE))), 0)) AS s FROM customer)")
def significant_digits(spark, tables):
    return tables("customer").select("c_custkey", writers.significant(F.col("c_acctbal").cast("double")).alias("shown"))


@query("linear_pivots", "SELECT round(2020 - i * 0.25::DOUBLE, 4) AS \"pivot\" FROM range(0, 21) t(i)")
def linear_pivots(spark, tables):
    return frequencies.pivot_frame(spark, frequencies.linear_pivots(2015.0, 2020.0, 0.25))


@query("exclude_all", "SELECT 'filter_by_exclude_all' AS filter, count(*) AS n FROM customer")
def exclude_all(spark, tables):
    return predicates.attributed(tables("customer"), [predicates.exclude_all()]).groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query("curate_passthru", "SELECT n_nationkey, n_name FROM nation")
def curate_passthru(spark, tables):
    before = tables("nation").select("n_nationkey", "n_name")
    after = curate.STEPS["passthru"](before)
    curate.check_same_fields(before, after)
    return after


@query("distance_edges", "SELECT n_regionkey AS first, n_nationkey AS second, n_nationkey - n_regionkey AS distance FROM nation")
def distance_edges(spark, tables):
    return distance.edge_list(tables("nation").select(F.col("n_regionkey").alias("first"), F.col("n_nationkey").alias("second"), (F.col("n_nationkey") - F.col("n_regionkey")).alias("distance")))
