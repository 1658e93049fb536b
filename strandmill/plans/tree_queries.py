"""Tree operators on a heap-shaped tree of all customers: the parent of k is k div 2, and a customer's k is its key and one."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import clades, tree
from strandmill.plans.registry import query

#: The tree and the closure in SQL.
_NODES = "n AS (SELECT c_custkey + 1 AS node, CASE WHEN c_custkey > 0 THEN (c_custkey + 1) // 2 END AS parent, abs(c_acctbal) / 1000 AS len, 2 * (c_custkey + 1) > (SELECT max(c_custkey) + 1 FROM customer) AS is_tip FROM customer)"
_UP = "up(anc, \"desc\", steps, dist) AS (SELECT node, node, 0, 0.0::DOUBLE FROM n UNION ALL SELECT p.parent, u.\"desc\", u.steps + 1, u.dist + p.len FROM up u JOIN n p ON u.anc = p.node WHERE p.parent IS NOT NULL)"
_TREE = f"WITH RECURSIVE {_NODES}, {_UP}"


def heap_nodes(tables):
    """Nodes with depth; keys are consecutive, so a node is a tip if twice its key is too large."""
    c = tables("customer")
    last = c.agg((F.max("c_custkey") + 1).alias("last"))
    key = F.col("c_custkey") + 1
    return c.crossJoin(F.broadcast(last)).select(
        F.lit("heap").alias("tree_id"), key.cast("string").alias("node"), F.when(key > 1, F.floor(key / 2).cast("string")).alias("parent"),
        (F.abs("c_acctbal") / 1000).alias("branch_length"), (2 * key > F.col("last")).alias("is_tip"), F.floor(F.log2(key.cast("double")) + 1e-9).cast("int").alias("depth"), key.cast("int").alias("pre"),
    )


@query("tree_leaf_counts", f"{_TREE} SELECT anc::VARCHAR AS node, count(*) AS leaves FROM up JOIN n ON \"desc\" = node WHERE is_tip GROUP BY 1")
def tree_leaf_counts(spark, tables):
    nodes = heap_nodes(tables)
    return tree.leaf_counts(nodes)


@query("tree_cumulative_divergence", f"{_TREE} SELECT \"desc\"::VARCHAR AS node, round(dist, 6) AS div FROM up WHERE anc = 1")
def tree_cumulative_divergence(spark, tables):
    nodes = heap_nodes(tables)
    return tree.cumulative_divergence(nodes).select("node", F.round("div", 6).alias("div"))


@query("tree_recursive_depth", f"{_TREE} SELECT \"desc\"::VARCHAR AS node, max(steps) AS depth FROM up GROUP BY 1")
def tree_recursive_depth(spark, tables):
    edges = heap_nodes(tables).select("node", "parent", "branch_length")
    return tree.nodes_of_edges(edges).select("node", "depth")


@query("tree_propagate_labels", f"{_TREE} SELECT \"desc\"::VARCHAR AS node, coalesce('label' || arg_min(anc, steps) FILTER (WHERE anc % 7 = 0), 'unassigned') AS label FROM up GROUP BY 1")
def tree_propagate_labels(spark, tables):
    nodes = heap_nodes(tables)
    labels = nodes.where(F.col("node").cast("int") % 7 == 0).select("node", F.concat(F.lit("label"), "node").alias("label"))
    return tree.nearest_labelled(nodes, labels, "unassigned")


@query("tree_last_ancestor", f"{_TREE}, d AS (SELECT node, 2000 + floor(log2(node + 0.5)) + (node % 3) / 10.0::DOUBLE AS num_date, is_tip FROM n) SELECT u.\"desc\"::VARCHAR AS node, coalesce(arg_min(u.anc, u.steps) FILTER (WHERE a.num_date <= 2005), 1)::VARCHAR AS ancestor FROM up u JOIN d t ON u.\"desc\" = t.node JOIN d a ON u.anc = a.node WHERE u.steps > 0 AND t.is_tip AND t.num_date > 2005 GROUP BY 1")
def tree_last_ancestor(spark, tables):
    nodes = heap_nodes(tables)
    key = F.col("node").cast("int")
    dated = nodes.withColumn("num_date", 2000 + F.floor(F.log2(key + 0.5)) + (key % 3) / 10.0)
    return tree.last_ancestor_before(dated, 2005)


def heap_mutations(tables):
    """Mutations on branches: gene by return flag, place by line number, allele by status."""
    last = tables("customer").agg(F.max("c_custkey").alias("last"))
    rows = tables("lineitem").crossJoin(F.broadcast(last)).select((F.col("l_orderkey") % F.col("last") + 1).alias("node"), F.concat(F.lit("g"), "l_returnflag").alias("gene"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("alt"))
    known = tables("customer").where("c_custkey > 0").select(F.col("c_custkey").alias("node"))
    return rows.join(known, "node", "left_semi").groupBy("node", "gene", "pos").agg(F.min("alt").alias("alt")).withColumn("node", F.col("node").cast("string"))


_MUTATIONS = "m AS (SELECT l_orderkey % (SELECT max(c_custkey) FROM customer) + 1 AS node, 'g' || l_returnflag AS gene, l_linenumber AS pos, min(l_linestatus) AS alt FROM lineitem WHERE l_orderkey % (SELECT max(c_custkey) FROM customer) + 1 IN (SELECT c_custkey FROM customer WHERE c_custkey > 0) GROUP BY ALL)"
_STATES = "s AS (SELECT \"desc\" AS node, gene, pos, arg_min(alt, steps) AS alt FROM up JOIN m ON anc = m.node GROUP BY ALL)"


@query("tree_inherited_state", f"{_TREE}, {_MUTATIONS}, {_STATES} SELECT node::VARCHAR AS node, gene, pos, alt FROM s")
def tree_inherited_state(spark, tables):
    return tree.inherited_state(heap_nodes(tables), heap_mutations(tables))


_CLADES = """c(clade, gene, pos, alt) AS (VALUES ('A', 'gN', 1, 'O'), ('B', 'gN', 1, 'O'), ('B', 'gN', 2, 'O'), ('C', 'gR', 1, 'F'), ('C', 'gA', 2, 'F'), ('D', 'gN', 3, 'O'), ('D', 'gA', 1, 'F')),
  r(gene, pos, state) AS (VALUES ('gN', 1, 'x'), ('gA', 1, 'F')),
  h AS (SELECT clade, n.node, bool_and(coalesce(s.alt, state, '?') = c.alt) AS ok FROM c CROSS JOIN n LEFT JOIN r USING (gene, pos) LEFT JOIN s ON s.node = n.node AND s.gene = c.gene AND s.pos = c.pos GROUP BY ALL),
  l AS (SELECT anc AS node, count(*) AS leaves FROM up JOIN n ON "desc" = node WHERE is_tip GROUP BY 1),
  b AS (SELECT clade, arg_max(node, leaves * 1000000 - node) AS node FROM h JOIN l USING (node) WHERE ok GROUP BY clade),
  z AS (SELECT node, arg_max(clade, (SELECT count(*) FROM c WHERE c.clade = b.clade) * 1000 + ascii(clade)) AS clade FROM b GROUP BY node)"""


@query("clade_assignment", f"{_TREE}, {_MUTATIONS}, {_STATES}, {_CLADES} SELECT \"desc\"::VARCHAR AS node, coalesce(arg_min(z.clade, steps) FILTER (WHERE z.clade IS NOT NULL), 'unassigned') AS clade FROM up LEFT JOIN z ON anc = z.node GROUP BY 1")
def clade_assignment(spark, tables):
    nodes = heap_nodes(tables)
    rows = [("A", "gN", 1, "O"), ("B", "clade", "A", ""), ("B", "gN", 2, "O"), ("C", "gR", 1, "F"), ("C", "gA", 2, "F"), ("D", "gN", 3, "O"), ("D", "gA", 1, "F")]
    definitions = spark.createDataFrame(clades.inherited_definitions(rows), "clade string, gene string, pos int, alt string")
    root = spark.createDataFrame([("gN", 1, "x"), ("gA", 1, "F")], "gene string, pos int, state string")
    member, _ = clades.assign_clades(nodes, heap_mutations(tables), definitions, root)
    return member


@query("sequence_traits", "WITH m AS (SELECT l_orderkey % 500 AS sample, l_linenumber AS pos, l_linestatus AS alt FROM lineitem), f(pos, alt, name, feature) AS (VALUES (1, 'O', '1O', 'x'), (2, 'O', '2O', 'x'), (2, 'F', '2F', 'y')), h AS (SELECT DISTINCT sample, name, feature FROM m JOIN f USING (pos, alt)) SELECT sample, feature, string_agg(name, ',' ORDER BY name) AS mutations, max(k) AS feature_count FROM (SELECT *, (SELECT count(DISTINCT feature) FROM h b WHERE b.sample = h.sample) AS k FROM h) GROUP BY ALL")
def sequence_traits(spark, tables):
    rows = tables("lineitem").select((F.col("l_orderkey") % 500).alias("sample"), F.lit("nuc").alias("gene"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("alt")).distinct()
    features = spark.createDataFrame([("nuc", 1, "O", "1O", "x"), ("nuc", 2, "O", "2O", "x"), ("nuc", 2, "F", "2F", "y")], "gene string, pos int, alt string, display_name string, feature string")
    return clades.sequence_traits(rows, features)


@query("branch_changes", f"WITH {_NODES}, s AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 10 >= 3 THEN c_mktsegment ELSE 'uncertain' END AS state FROM customer) SELECT n.node::VARCHAR AS node, p.state || ' → ' || s.state AS label FROM n JOIN s ON n.node = s.node JOIN s p ON n.parent = p.node WHERE p.state <> s.state")
def branch_changes(spark, tables):
    states = tables("customer").select(F.col("c_custkey").cast("string").alias("node"), F.col("c_mktsegment").alias("state"), ((F.col("c_custkey") % 10) / 10).alias("confidence"))
    return tree.branch_changes(heap_nodes(tables), states, 0.3)


@query("unique_labels", "SELECT c_custkey::VARCHAR AS node, CASE WHEN count(*) OVER w > 1 THEN n || '_' || row_number() OVER (PARTITION BY n ORDER BY c_custkey::VARCHAR) ELSE n END AS label FROM (SELECT c_custkey, c_mktsegment || (c_custkey % 200) AS n FROM customer) WINDOW w AS (PARTITION BY n)")
def unique_labels(spark, tables):
    return tree.unique_labels(tables("customer").select(F.col("c_custkey").cast("string").alias("node"), F.concat("c_mktsegment", F.col("c_custkey") % 200).alias("label")))


@query("tree_layout", None)
def tree_layout(spark, tables):
    return tree.layout(heap_nodes(tables))


@query("tree_lbi", None)
def tree_lbi(spark, tables):
    dated = heap_nodes(tables).withColumn("num_date", F.lit(2000.0) + F.col("depth"))
    return tree.local_branching_index(dated, tau=0.4, window=2.0)


@query(
    "reconstruct_sequences",
    f"""{_TREE}, {_MUTATIONS.replace("'g' || l_returnflag", "''")}, {_STATES} SELECT n.node::VARCHAR AS node, {" || ".join(f"coalesce((SELECT max(alt) FROM s WHERE s.node = n.node AND pos = {i}), 'A')" for i in range(1, 9))} AS sequence FROM n""",
)
def reconstruct_sequences(spark, tables):
    mutations = heap_mutations(tables).groupBy("node", "pos").agg(F.min("alt").alias("alt"))
    return clades.reconstruct("AAAAAAAA", heap_nodes(tables), mutations)


@query("node_attributes", "SELECT (c_custkey + 1)::VARCHAR AS node, CASE WHEN c_custkey % 2 = 0 THEN 'd' || c_custkey ELSE c_mktsegment END AS segment, c_name AS author FROM customer")
def node_attributes(spark, tables):
    from strandmill.operators import export

    c = tables("customer")
    meta = c.select((F.col("c_custkey") + 1).cast("string").alias("strain"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("authors"))
    data = c.select((F.col("c_custkey") + 1).cast("string").alias("node"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("d"), "c_custkey")).otherwise("?").alias("segment"))
    return export.node_attributes(heap_nodes(tables), meta, data, "strain", ["segment", "authors"]).select("node", "segment", "author")


@query("attribute_values", "SELECT 'segment' AS attribute, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'nation', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY ALL")
def attribute_values(spark, tables):
    from strandmill.operators import export

    df = tables("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return export.value_sets(df, ["segment", "nation"])
