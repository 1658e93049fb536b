"""Checks, reports of weights and groups, and readers of small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import dates, sequences
from strandmill.operators import checks, predicates, sampling
from strandmill.plans import dag
from strandmill.plans.filter_queries import DRAW, orders_metadata
from strandmill.plans.operator_queries import _lines
from strandmill.plans.registry import query
from strandmill.plans.tree_queries import heap_nodes
from strandmill.sources import readers

_VAGUE = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-XX') WHEN 1 THEN strftime(o_orderdate, '%Y-XX-XX') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN '199X-XX-XX' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


def vague_orders(tables):
    """Orders with dates that lack a day, a month, a year or nothing."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(key == 0, F.date_format(day, "yyyy-MM-'XX'")).when(key == 1, F.date_format(day, "yyyy-'XX-XX'")).when(key == 2, F.date_format(day, "yyyy-MM"))
    text = text.when(key == 3, "199X-XX-XX").otherwise(F.date_format(day, "yyyy-MM-dd"))
    return tables("orders").select(F.col("o_orderkey").cast("string").alias("strain"), text.alias("date"), F.col("o_orderpriority").alias("priority"))


@query(
    "grouping_ambiguity",
    "SELECT key AS \"by\", CASE WHEN o_orderkey % 5 = 3 THEN 'skip_group_by_with_ambiguous_year' WHEN key <> 'year' AND o_orderkey % 5 = 1 THEN 'skip_group_by_with_ambiguous_month' WHEN key = 'week' AND o_orderkey % 5 IN (0, 2) THEN 'skip_group_by_with_ambiguous_day' END AS filter, count(*) AS n FROM orders, (VALUES ('year'), ('month'), ('week'), ('priority')) v(key) WHERE key <> 'priority' GROUP BY ALL UNION ALL SELECT 'priority', NULL, count(*) FROM orders",
)
def grouping_ambiguity(spark, tables):
    """The filters that each key to group by brings with it, over all orders."""
    df = vague_orders(tables)
    each = [predicates.attributed(df, sampling.grouping_filters(df, [key])).select(F.lit(key).alias("by"), "filter") for key in ("year", "month", "week", "priority")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).groupBy("by", "filter").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_vague_groups",
    f"SELECT o_orderkey::VARCHAR AS strain, {_VAGUE} AS date FROM orders WHERE o_orderkey % 5 NOT IN (1, 3) QUALIFY row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY {DRAW.format(seed='m', id='o_orderkey')} DESC, o_orderkey::VARCHAR DESC) <= 2",
)
def sample_vague_groups(spark, tables):
    """Two orders a month; orders whose month is unknown are in no group."""
    df = vague_orders(tables)
    samples = dag.parse({"samples": {"m": {"group_by": ["month"], "group_size": 2}}})
    return dag.united(samples, dag.run(samples, df, "strain"), df, "strain").select("strain", "date")


def _weighted_groups(spark, tables):
    counts = sampling.group_keys(orders_metadata(tables), ["priority", "status"]).groupBy("group_priority", "group_status").agg(F.count(F.lit(1)).alias("n"))
    weights = spark.createDataFrame([("1-URGENT", 3.0), ("2-HIGH", 2.0), ("9-NEVER", 7.0), ("default", 0.5)], "priority string, weight double")
    return counts, weights


_GROUPS = """g AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL),
  p AS (SELECT DISTINCT priority FROM g), w AS (SELECT priority, CASE priority WHEN '1-URGENT' THEN 3.0::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM p)"""


@query(
    "weights_report",
    f"""WITH {_GROUPS}, s AS (SELECT priority, status, weight / count(*) OVER (PARTITION BY priority) AS weight, n AS input_size, floor(weight / count(*) OVER (PARTITION BY priority) / (SELECT sum(weight) FROM w) * (SELECT count(*) * 2 FROM orders) + 0.25)::INT AS target_size FROM g JOIN w USING (priority))
  SELECT priority, status, round(weight, 9) AS weight, input_size, target_size, least(input_size, target_size) AS output_size, input_size < target_size AS under_sampled FROM s""",
)
def weights_report(spark, tables):
    """Sizes of weighted groups where twice the rows that there are is asked for."""
    counts, weights = _weighted_groups(spark, tables)
    total = tables("orders").count() * 2
    sizes = sampling.weighted_sizes(counts, weights, ["priority"], ["priority", "status"], total, F.lit(0.25))
    return sampling.size_report(sizes).withColumn("weight", F.round("weight", 9))


@query(
    "weights_coverage",
    f"WITH {_GROUPS} SELECT 'default' AS kind, priority AS value, NULL::BIGINT AS n FROM p WHERE priority NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'unused', '9-NEVER', NULL UNION ALL SELECT 'skipped', NULL, 3 * (SELECT count(DISTINCT status) FROM g) - (SELECT count(*) FROM g WHERE priority IN ('1-URGENT', '2-HIGH'))",
)
def weights_coverage(spark, tables):
    """Values that only the fallback covers, weights that no group uses, combinations without rows."""
    counts, weights = _weighted_groups(spark, tables)
    none = F.lit(None).cast("long").alias("n")
    gaps = sampling.weight_gaps(counts, weights, ["priority"]).select(F.lit("default").alias("kind"), "value", none)
    unused = sampling.unused_weights(counts, weights, ["priority"]).select(F.lit("unused").alias("kind"), F.col("group_priority").alias("value"), none)
    skipped = sampling.skipped_groups(counts, weights, ["priority"], ["priority", "status"]).select(F.lit("skipped").alias("kind"), F.lit(None).cast("string").alias("value"), F.col("skipped").alias("n"))
    return gaps.unionByName(unused).unionByName(skipped)


@query("group_values", "SELECT 'priority' AS \"column\", o_orderpriority AS value FROM orders GROUP BY ALL UNION ALL SELECT 'status', o_orderstatus FROM orders GROUP BY ALL")
def group_values(spark, tables):
    counts, _ = _weighted_groups(spark, tables)
    return sampling.distinct_values(counts, ["priority", "status"])


@query("date_ambiguity_errors", "SELECT CASE o_orderkey % 5 WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS error, count(*) AS n FROM orders GROUP BY 1")
def date_ambiguity_errors(spark, tables):
    """What is wrong with dates whose unknown parts are followed by known ones."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(key == 0, F.date_format(day, "yyyy-MM-'XX'")).when(key == 1, F.date_format(day, "yyyy-'XX'-dd")).when(key == 2, F.date_format(day, "'199X'-MM-'XX'")).when(key == 3, F.date_format(day, "yyyy-'XX-XX'")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return tables("orders").select(dates.ambiguity_error(text).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("repeated_ids_kept", "SELECT conv_id, turn, role FROM conversations")
def repeated_ids_kept(spark, tables):
    """All rows of a table with repeated ids, which are warned of."""
    return checks.with_policy(tables("conversations"), "conv_id", "warn").select("conv_id", "turn", "role")


@query("name_differences", "SELECT 'alignment' AS side, p_name AS name FROM part GROUP BY ALL UNION ALL SELECT 'alignment', (c_custkey + 2)::VARCHAR FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer) UNION ALL SELECT 'tree', (c_custkey + 1)::VARCHAR FROM customer WHERE c_custkey = 0")
def name_differences(spark, tables):
    """Names of all nodes of the customer tree against names one higher and those of parts."""
    names = tables("customer").select((F.col("c_custkey") + 2).cast("string").alias("id")).unionAll(tables("part").select("p_name"))
    return checks.name_differences(names, heap_nodes(tables).select("node"))


@query(
    "author_contradictions",
    "WITH o AS (SELECT 'a' || o_custkey AS authors, trim(o_orderstatus || ' ') AS title, strftime(o_orderdate, '%Y') AS journal, o_orderkey FROM orders) SELECT authors, count(*) AS n, arg_max(title, o_orderkey) AS title, arg_max(journal, o_orderkey) AS journal, array_to_string(list_filter([CASE WHEN count(DISTINCT title) > 1 THEN 'title' END, CASE WHEN count(DISTINCT journal) > 1 THEN 'journal' END], lambda x: x IS NOT NULL), ',') AS contradictory FROM o GROUP BY 1 HAVING bool_or(o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))",
)
def author_contradictions(spark, tables):
    """Customers as authors of their orders; orders with a returned item are the tips."""
    df = tables("orders").select("o_orderkey", F.concat(F.lit("a"), "o_custkey").alias("authors"), F.concat("o_orderstatus", F.lit(" ")).alias("title"), F.date_format("o_orderdate", "yyyy").alias("journal"))
    tips = tables("lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return checks.author_info(df, tips, "o_orderkey", "o_orderkey").withColumn("contradictory", F.array_join("contradictory", ","))


@query("measurement_keys", "SELECT 'text' AS kind, k AS key FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events) UNION ALL SELECT DISTINCT 'map', l_returnflag || l_linestatus FROM lineitem")
def measurement_keys(spark, tables):
    """Keys that occur in any row, of JSON objects and of maps."""
    maps = tables("lineitem").select(F.create_map(F.concat("l_returnflag", "l_linestatus"), "l_quantity").alias("m"))
    text = checks.unique_keys(tables("events"), "props").select(F.lit("text").alias("kind"), "key")
    return text.unionByName(checks.unique_keys(maps, "m").select(F.lit("map").alias("kind"), "key"))


@query("not_indexed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_indexed(spark, tables):
    """Documents that an index of the labelled ones lacks."""
    docs = tables("documents").select("doc_id", "text")
    index = sequences.nucleotide_index(docs.join(tables("labels").select("doc_id"), "doc_id", "left_semi"), "doc_id", "text")
    return checks.not_indexed(docs, checks.check_index_kind(index, "nuc"), "doc_id")


def _table(spark, tables, head, df, name, *values):
    """A tab-separated file of ``values`` of ``df`` (with ord) under header lines."""
    body = df.select(F.col("ord").cast("long").alias("ord"), F.concat_ws("\t", *[v.cast("string") for v in values]).alias("value"))
    return _lines(spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "ord long, value string").unionByName(body), tables, name)


def _parts(tables, df, name, *values, head=None):
    """A folder of tab-separated part files of ``values`` of ``df``, one a task and in no order,
    each with the header line, if one is given: large tables are neither sorted nor met in one task."""
    path = tables.fresh(name)
    named = [v.cast("string").alias(n) for v, n in zip(values, head or [f"_c{i}" for i in range(len(values))], strict=True)]
    df.select(*named).write.csv(path, sep="\t", header=head is not None)
    return path


@query("file_gff", "SELECT n_name AS name, 'gene' AS type, n_nationkey * 30 AS start, n_nationkey * 30 + 15 + n_regionkey AS \"end\", CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE -1 END AS strand, 780 AS extent, n_regionkey % 3 <> 0 AS wrong FROM nation")
def file_gff(spark, tables):
    """Genes of an annotation, the extent that directive and region agree on, and lengths that are no codons."""
    df = tables("nation").withColumn("ord", F.col("n_nationkey"))
    start = F.col("n_nationkey") * 30
    dot = F.lit(".")
    head = ["##gff-version 3", "##sequence-region chrom 1 780", "\t".join(["chrom", ".", "region", "1", "780", ".", "+", ".", "ID=chrom"])]
    path = _table(spark, tables, head, df, "genes.gff", F.lit("chrom"), dot, F.lit("gene"), start + 1, start + 15 + F.col("n_regionkey"), dot, F.when(F.col("n_regionkey") % 2 == 0, "+").otherwise("-"), dot, F.concat(F.lit("ID=x;gene="), "n_name"))
    genes = readers.read_gff(spark, path).where("type = 'gene'")
    wrong = readers.feature_errors(genes).select("name", F.lit(True).alias("wrong"))
    low, high = readers.gff_extent(spark, path)
    return genes.join(wrong, "name", "left").select("name", "type", "start", "end", "strand", F.lit(high - low).alias("extent"), F.coalesce("wrong", F.lit(False)).alias("wrong"))


@query("file_weights", "SELECT n_name AS nation, n_regionkey + 0.5::DOUBLE AS weight, 'nation' AS columns FROM nation")
def file_weights(spark, tables):
    path = _table(spark, tables, ["nation\tweight"], tables("nation").withColumn("ord", F.col("n_nationkey")), "weights.tsv", F.col("n_name"), F.col("n_regionkey") + F.lit(0.5))
    found, columns = readers.read_weights(spark, path)
    return found.withColumn("columns", F.lit(",".join(columns)))


@query("file_annotations", "SELECT s_suppkey::VARCHAR AS id, 'nation' AS field, s_nationkey::VARCHAR AS value, (row_number() OVER (ORDER BY s_suppkey))::INT AS line FROM supplier")
def file_annotations(spark, tables):
    df = tables("supplier").withColumn("ord", F.col("s_suppkey"))
    path = _table(spark, tables, ["# id\tfield\tvalue"], df, "annotations.tsv", F.col("s_suppkey"), F.lit("nation"), F.concat(F.col("s_nationkey").cast("string"), F.lit(" # why")))
    return readers.read_annotations(spark, path)


@query("file_titers", "SELECT 't' || l_partkey AS test, 'r' || l_suppkey AS ref, 's' || l_linenumber AS serum, l_returnflag AS source, l_quantity::DOUBLE * CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS titer FROM lineitem WHERE l_returnflag <> 'R'")
def file_titers(spark, tables):
    df = tables("lineitem")
    text = F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("double").cast("string")).otherwise((F.col("l_quantity").cast("double") * 2).cast("string"))
    path = _parts(tables, df, "titers.tsv", F.concat(F.lit("t"), "l_partkey"), F.concat(F.lit("r"), "l_suppkey"), F.concat(F.lit("s"), "l_linenumber"), F.col("l_returnflag"), text)
    return readers.read_titer_table(spark, path, ["R"])


@query("file_measurements", "SELECT 'e' || event_id AS strain, value, event_type AS type FROM events")
def file_measurements(spark, tables):
    path = _parts(tables, tables("events"), "measurements.tsv", F.col("event_type"), F.col("value"), F.concat(F.lit("e"), "event_id"), head=["type", "value", "name"])
    return readers.read_collection(spark, path, "name")


@query("file_features", "SELECT CASE WHEN n_regionkey = 0 THEN 'nuc' ELSE 'g' || n_regionkey END AS gene, n_nationkey AS pos, 'A' AS alt, n_nationkey || 'A' AS display_name, n_name AS feature FROM nation")
def file_features(spark, tables):
    df = tables("nation").withColumn("ord", F.col("n_nationkey"))
    gene = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("g"), "n_regionkey"))
    return readers.read_features(spark, _table(spark, tables, ["gene\tsite\talt\tfeature"], df, "features.tsv", gene, F.col("n_nationkey"), F.lit("A"), F.col("n_name")))


@query("file_clades", "SELECT r_name AS clade, 'nuc' AS gene, r_regionkey AS pos, 'A' AS alt FROM region UNION ALL SELECT n_name, 'g', n_nationkey, 'T' FROM nation UNION ALL SELECT n_name, 'nuc', n_regionkey, 'A' FROM nation")
def file_clades(spark, tables):
    """Nations as clades that inherit the allele of their region."""
    nation, region = tables("nation"), tables("region")
    rows = region.select(F.col("r_regionkey").alias("ord"), F.concat_ws("\t", "r_name", F.lit("nuc"), F.col("r_regionkey").cast("string"), F.lit("A")).alias("value"))
    parents = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 100).alias("ord"), F.concat_ws("\t", "n_name", F.lit("clade"), "r_name", F.lit("")).alias("value"))
    own = nation.select((F.col("n_nationkey") + 200).alias("ord"), F.concat_ws("\t", "n_name", F.lit("g"), F.col("n_nationkey").cast("string"), F.lit("T")).alias("value"))
    head = spark.createDataFrame([(-1, "clade\tgene\tsite\talt")], "ord long, value string")
    path = _lines(head.unionByName(rows.withColumn("ord", F.col("ord").cast("long"))).unionByName(parents).unionByName(own), tables, "clades.tsv")
    return readers.read_clade_definitions(spark, path)
