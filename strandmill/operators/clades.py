"""Clades from signature mutations, sequence traits, and states along a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.operators import tree


def inherited_definitions(rows: list[tuple[str, str, int, str]]) -> list[tuple[str, str, int, str]]:
    """Definitions with those of ancestor clades; ``gene = 'clade'`` names the parent.

    Own alleles override inherited ones. Raises on cycles, several parents, or a
    parent that is not defined.
    """
    parents: dict[str, str] = {}
    own: dict[str, dict[tuple[str, int], str]] = {}
    for clade, gene, site, alt in rows:
        if gene == "clade":
            if parents.get(clade, site) != site:
                raise ValueError(f"clade {clade!r} inherits from several clades")
            parents[clade] = str(site)
            own.setdefault(clade, {})
        else:
            own.setdefault(clade, {})[(gene, int(site))] = alt
    for clade, parent in parents.items():
        if parent not in own:
            raise ValueError(f"clade {clade!r} inherits from {parent!r}, which is not defined")
    out = []
    for clade in own:
        line, at = [clade], clade
        while at in parents:
            at = parents[at]
            if at in line:
                raise ValueError(f"clades inherit in a cycle: {line}")
            line.append(at)
        merged: dict[tuple[str, int], str] = {}
        for name in reversed(line):
            merged |= own[name]
        out += [(clade, gene, site, alt) for (gene, site), alt in merged.items()]
    return out


def repeated_mutations(mutations: DataFrame) -> DataFrame:
    """Branches with several mutations at one place."""
    return mutations.groupBy("node", "gene", "pos").count().where("count > 1")


def matching_nodes(definitions: DataFrame, states: DataFrame, nodes: DataFrame, root_state: DataFrame) -> DataFrame:
    """(clade, node) where a node has all alleles of a clade: a relational division.

    A place without a mutation on the way has the root's state. Only nodes with
    at least one allele of their own can match a clade through mutations, so the
    candidates come from an equi-join; clades that the root's state satisfies
    entirely match by the root's state where nothing has mutated away.
    """
    wanted = definitions.join(root_state.withColumnRenamed("state", "root"), ["gene", "pos"], "left")
    wanted = wanted.withColumn("by_root", F.coalesce((F.col("root") == F.col("alt")).cast("int"), F.lit(0)))
    need = wanted.groupBy("clade").agg(F.count(F.lit(1)).alias("need"), F.sum("by_root").alias("from_root"))
    hits = wanted.join(states.withColumnRenamed("alt", "has"), ["gene", "pos"])
    # A mutated place counts by its own allele instead of the root's.
    change = (F.col("has") == F.col("alt")).cast("int") - F.col("by_root")
    gained = hits.groupBy("clade", "node").agg(F.sum(change).alias("gained"))
    through = gained.join(need, "clade").where("from_root + gained = need").select("clade", "node")
    full = need.where("from_root = need").select("clade")
    quiet = nodes.select("node").crossJoin(F.broadcast(full)).join(gained, ["clade", "node"], "left_anti").select("clade", "node")
    return through.unionByName(quiet)


def assign_clades(nodes: DataFrame, mutations: DataFrame, definitions: DataFrame, root_state: DataFrame, missing: str = "unassigned") -> tuple[DataFrame, DataFrame]:
    """(membership: node, clade; labels: node, clade).

    A clade's label goes to the matching node with most tips, the first in
    pre-order on ties; membership runs down to the next label.
    """
    states = tree.inherited_state(nodes, mutations)
    matches = matching_nodes(definitions, states, nodes, root_state)
    sized = matches.join(tree.leaf_counts(nodes), "node").join(nodes.select("node", "pre"), "node")
    best = sized.groupBy("clade").agg(F.max_by("node", F.struct(F.col("leaves"), -F.col("pre"))).alias("node"))
    # Several clades at one node: the one defined by more alleles, then the later name, is shown.
    size = definitions.groupBy("clade").agg(F.count(F.lit(1)).alias("alleles"))
    shown = best.join(size, "clade").groupBy("node").agg(F.max_by("clade", F.struct("alleles", "clade")).alias("label"))
    member = tree.nearest_labelled(nodes, shown, missing).withColumnRenamed("label", "clade")
    return member, best.select("node", "clade")


def root_reference(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """(gene, pos, state) of the root's sequences (node, gene, sequence)."""
    root = nodes.where("parent is null").select("node")
    return sequences.join(F.broadcast(root), "node").select("gene", F.posexplode(F.split("sequence", "")).alias("pos", "state")).withColumn("pos", F.col("pos") + 1)


def sequence_traits(mutations: DataFrame, features: DataFrame, count: str = "traits") -> DataFrame:
    """(sample, feature_count, and per feature the mutations) of observed signatures.

    ``mutations`` (sample, gene, pos, alt); ``features`` (gene, pos, alt, display_name,
    feature). ``count`` counts distinct features (traits) or hits (mutations).
    """
    hits = mutations.join(features, ["gene", "pos", "alt"])
    number = F.count_distinct("feature") if count == "traits" else F.count(F.lit(1))
    per = hits.groupBy("sample", "feature").agg(F.array_join(F.array_sort(F.collect_list("display_name")), ",").alias("mutations"))
    return per.join(hits.groupBy("sample").agg(number.alias("feature_count")), "sample")


def confidence_entropy(confidences: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """Entropy of each node's state distribution (node, state, p)."""
    return confidences.groupBy("node").agg((-F.sum(F.col("p") * F.log(F.col("p") + epsilon))).alias("entropy"))


def reconstruct(root_sequence: str, nodes: DataFrame, mutations: DataFrame) -> DataFrame:
    """(node, sequence) of every node: the root's sequence under inherited mutations."""
    from strandmill.functions.sequences import applied

    states = tree.inherited_state(nodes, mutations.withColumn("gene", F.lit("")))
    changes = states.groupBy("node").agg(F.collect_list(F.struct("pos", "alt")).alias("changes"))
    every = nodes.select("node").join(changes, "node", "left")
    none = F.array().cast("array<struct<pos:int,alt:string>>")
    return every.select("node", applied(F.lit(root_sequence), F.coalesce(F.col("changes").cast("array<struct<pos:int,alt:string>>"), none)).alias("sequence"))


def branch_mutations(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """(node, gene, mutations) of each branch from its parent's sequence (node, gene, sequence)."""
    from strandmill.functions.sequences import mutations

    child = nodes.where("parent is not null").select("node", "parent").join(sequences, "node")
    above = sequences.select(F.col("node").alias("parent"), "gene", F.col("sequence").alias("before"))
    return child.join(above, ["parent", "gene"]).select("node", "gene", mutations(F.col("before"), F.col("sequence")).alias("mutations"))


def ambiguous_columns(alignment: DataFrame, unknown: str = "N") -> DataFrame:
    """Places where every sequence (id, sequence) is unknown."""
    letters = alignment.select(F.posexplode(F.split("sequence", "")).alias("pos", "letter"))
    return letters.groupBy("pos").agg(F.min((F.col("letter") == unknown).cast("int")).alias("all_unknown")).where("all_unknown = 1").select("pos")


def informative_sites(alignment: DataFrame) -> DataFrame:
    """Places with two or more known states that are not one state and a single other."""
    letters = alignment.select(F.posexplode(F.split(F.upper("sequence"), "")).alias("pos", "letter")).where(~F.col("letter").isin("N", "-"))
    counted = letters.groupBy("pos", "letter").count()
    states = counted.groupBy("pos").agg(F.count(F.lit(1)).alias("states"), F.sum((F.col("count") == 1).cast("int")).alias("singles"))
    return states.where("states >= 2 and not (states = 2 and singles = 1)").select("pos")


def author_labels(rows: DataFrame) -> DataFrame:
    """(author, title, journal, label): authors with several works get a letter in order
    of first appearance (``seen``): A to Z, then AA."""
    works = rows.groupBy("author", "title", "journal").agg(F.min("seen").alias("seen"))
    own = W.partitionBy("author")
    rank = F.row_number().over(own.orderBy("seen", "title", "journal")) - 1
    several = F.count(F.lit(1)).over(own) > 1
    return works.select("author", "title", "journal", F.when(several, F.concat_ws(" ", "author", letters(rank))).otherwise(F.col("author")).alias("label"))


def letters(number) -> F.col:
    """0 is A, 25 Z, 26 AA and so on: bijective numbers in base 26 of any length."""
    start = F.struct((number + 1).cast("long").alias("rest"), F.lit("").alias("text"))

    def step(a, _):
        one = F.struct(F.floor((a["rest"] - 1) / 26).cast("long").alias("rest"), F.concat(F.char((a["rest"] - 1) % 26 + 65), a["text"]).alias("text"))
        return F.when(a["rest"] > 0, one).otherwise(a)

    # Fourteen letters hold every long.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["text"])
