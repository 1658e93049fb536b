"""Trees as tables: nodes with nested-set places, closures, and operators on them.

A tree is one row per node: tree_id, node, parent, branch_length, is_tip and more.
``placed`` gives every node the interval [lo, hi] of the places below it, with its
depth, divergence and leaves, by pointer doubling over all partitions; for forests of
small trees ``placed_each`` walks every tree in one task. Whatever runs down or up a
tree is a recurrence of ``doubling`` or becomes segments of places, found among the
marked nodes alone, that are joined to the nodes by equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandmill.operators import doubling
from strandmill.storage import stored

#: Places of a tree at which intervals of marks are cut, so that no task has all marks of a key.
CHUNK_PLACES = 65_536

NODE_SCHEMA = "tree_id string, node string, parent string, branch_length double, is_tip boolean, depth int, pre int, post int"


def node_rows(records: list[dict], tree_id: str = "tree") -> list[tuple]:
    """Rows of NODE_SCHEMA from parsed nodes (name, parent, branch_length) in any order."""
    children: dict[str | None, list[dict]] = {}
    for record in records:
        children.setdefault(record["parent"], []).append(record)
    roots = children.get(None, [])
    if len(roots) != 1:
        raise ValueError(f"a tree needs one root, found {len(roots)}")
    rows, place, stack = {}, 0, [(roots[0], 0, False)]
    while stack:
        record, depth, done = stack.pop()
        name = record["name"]
        if done:
            rows[name][7] = place - 1
            continue
        if name in rows:
            raise ValueError(f"node name {name!r} occurs more than once")
        own = children.get(name, [])
        rows[name] = [tree_id, name, record["parent"], float(record.get("branch_length") or 0.0), not own, depth, place, place]
        place += 1
        stack.append((record, depth, True))
        stack += [(child, depth + 1, False) for child in reversed(own)]
    if len(rows) != len(records):
        raise ValueError("some nodes hang on no root")
    return [tuple(r) for r in rows.values()]


def tree_frame(spark: SparkSession, records: list[dict], tree_id: str = "tree") -> DataFrame:
    return spark.createDataFrame(node_rows(records, tree_id), NODE_SCHEMA)


def _with_leaf(nodes: DataFrame) -> DataFrame:
    """Nodes with ``_sm_leaf``, 1 for nodes that are nobody's parent."""
    parents = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("node")).distinct().withColumn("_sm_leaf", F.lit(0))
    return nodes.join(parents.hint("merge"), ["tree_id", "node"], "left").withColumn("_sm_leaf", F.coalesce("_sm_leaf", F.lit(1)).cast("long"))


def _length(nodes: DataFrame) -> Column:
    """Branch lengths, null ones as 0 and the root's left out."""
    return F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce(F.col("branch_length").cast("double"), F.lit(0.0)))


def _earlier(sized: DataFrame, by: str, column: str) -> Column:
    """What a node's earlier siblings have in all. Roots of one tree are siblings as well."""
    own = W.partitionBy("tree_id", "parent").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(own), F.lit(0)).cast("long")


def placed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with depth, lo, hi (places in pre-order of a node and its last descendant),
    leaves (tips at or below it) and div (branch lengths from the root, whose own is left out).

    Children follow ``pre``, if there, else their name; a node's place is its parent's, one
    more, and the sizes of earlier siblings. Two doublings, whatever the tree's shape;
    raises on nodes that hang in a circle. Empty tables have no places.
    """
    kept = [c for c in nodes.columns if c not in ("depth", "lo", "hi", "leaves", "div")]
    own, by = nodes.select(*kept), "pre" if "pre" in nodes.columns else "node"
    known = _with_leaf(own)
    one = F.lit(1).cast("long")
    sized = doubling.doubled(known, down={"steps": (None, one), "div": (None, _length(known))}, up={"size": (None, one), "leaves": (None, F.col("_sm_leaf"))})
    ranked = own.select("tree_id", "node", "parent", *({by} - {"node"})).join(sized.hint("merge"), ["tree_id", "node"])
    ranked = ranked.withColumn("_sm_ahead", _earlier(ranked, by, "size") + 1)
    place = doubling.doubled(ranked, down={"lo": (None, F.col("_sm_ahead"))})
    both = own.join(sized.hint("merge"), ["tree_id", "node"]).join(place.hint("merge"), ["tree_id", "node"])
    lo = F.col("lo") - 1
    return both.select(*kept, (F.col("steps") - 1).cast("int").alias("depth"), lo.alias("lo"), (lo + F.col("size") - 1).alias("hi"), "leaves", "div")


def placed_each(nodes: DataFrame) -> DataFrame:
    """``nodes`` with depth, lo, hi (places in pre-order of a node and its last descendant),
    leaves (tips at or below it) and div (branch lengths from the root, whose own is left out).

    For forests: one pass per tree, which must fit a task; children follow ``pre``, if there, else their
    name. Raises on a node without a way to a root.
    """
    own = [f for f in nodes.schema.fields if f.name not in ("depth", "lo", "hi", "leaves", "div")]
    schema = StructType([*own, *StructType.fromDDL("depth int, lo int, hi int, leaves long, div double").fields])
    names, by = [f.name for f in own], "pre" if "pre" in nodes.columns else "node"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, ignore_index=True)
        at = {name: i for i, name in enumerate(pdf["node"])}
        up = [at.get(parent, -1) for parent in pdf["parent"]]
        length, n = pdf["branch_length"].fillna(0.0).to_numpy(float), len(pdf)
        below: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(up):
            if p >= 0:
                below[p].append(i)
        order, depth, div = [], np.zeros(n, np.int32), np.zeros(n)
        stack = [i for i in reversed(range(n)) if up[i] < 0]
        while stack:
            i = stack.pop()
            order.append(i)
            if up[i] >= 0:
                depth[i], div[i] = depth[up[i]] + 1, div[up[i]] + length[i]
            stack += reversed(below[i])
        if len(order) < n:
            raise ValueError("some nodes hang on no root")
        lo, size, leaves = np.empty(n, np.int32), np.ones(n, np.int32), np.array([not b for b in below], np.int64)
        lo[order] = np.arange(n)
        for i in reversed(order):
            if up[i] >= 0:
                size[up[i]] += size[i]
                leaves[up[i]] += leaves[i]
        return pdf.assign(depth=depth, lo=lo, hi=lo + size - 1, leaves=leaves, div=div)[schema.names]

    return nodes.select(*names).groupBy("tree_id").applyInPandas(place, schema)


def nodes_of_edges(edges: DataFrame) -> DataFrame:
    """(node, parent, branch_length, is_tip, depth) from a table of edges, whatever their depth."""
    nodes = _with_leaf(edges.select(F.lit("tree").alias("tree_id"), "node", "parent", "branch_length"))
    steps = doubling.doubled(nodes, down={"steps": (None, F.lit(1).cast("long"))})
    return nodes.join(steps, ["tree_id", "node"]).select("node", "parent", "branch_length", (F.col("_sm_leaf") == 1).alias("is_tip"), (F.col("steps") - 1).cast("int").alias("depth"))


def closure(nodes: DataFrame) -> DataFrame:
    """(anc, desc, steps, dist) of every node with each ancestor and itself: an equi-join on
    places, as large as its result, which grows with the depth."""
    at = placed(nodes)
    above = at.select("tree_id", F.col("node").alias("anc"), F.col("depth").alias("d1"), F.col("div").alias("v1"), F.explode(F.sequence("lo", "hi")).alias("lo"))
    return above.join(at.select("tree_id", "lo", F.col("node").alias("desc"), "depth", "div"), ["tree_id", "lo"]).select("anc", "desc", (F.col("depth") - F.col("d1")).alias("steps"), (F.col("div") - F.col("v1")).alias("dist"))


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """Tips at or below every node."""
    return doubling.doubled(_with_leaf(nodes), up={"leaves": (None, F.col("_sm_leaf"))}).select("node", "leaves")


def cumulative_divergence(nodes: DataFrame) -> DataFrame:
    """Sum of branch lengths from the root, the root's own left out."""
    return doubling.doubled(nodes, down={"div": (None, _length(nodes))}).select("node", "div")


def nearest(at: DataFrame, marks: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, by, value): the value of the nearest marked ancestor or the node itself.

    ``at`` are placed nodes, ``marks`` (node, by, value). Without ``by`` the marks are doubled
    along the tree. With it, intervals of the nodes that one key marks nest or are apart,
    so the places where one of them is the nearest are few segments.
    """
    if not by:
        found = doubling.doubled(at.select("tree_id", "node", "parent").join(marks.select("node", "value"), "node", "left"), marks={"value": F.col("value")})
        return found.where("value is not null").select("node", "value")
    marked = marks.select("node", *by, "value").join(at.select("tree_id", "node", "lo", "hi").hint("merge"), "node")
    spread = _segments(marked, by).select("tree_id", *by, "value", F.explode(F.sequence("start", "end")).alias("lo"))
    return spread.join(at.select("tree_id", "lo", "node").hint("merge"), ["tree_id", "lo"]).select("node", *by, "value")


def _segments(marked: DataFrame, by: list[str]) -> DataFrame:
    """(tree_id, by, value, start, end): where the intervals [lo, hi] of ``marked``, which nest
    or are apart for one key, are the innermost ones.

    Intervals are cut at every ``CHUNK_PLACES`` places, and a window has the ones of one key and
    chunk. Of those that cover a whole chunk from further left only the last one counts there;
    the others begin or end in it. In a chunk, ends count down and starts count up, so
    after an end the innermost interval is the last one that started on the same level.
    """
    key, size = ["tree_id", *by], F.lit(CHUNK_PLACES).cast("long")
    first, last = F.floor(F.col("lo") / size), F.floor(F.col("hi") / size)
    own = marked.select(*key, "value", "lo", "hi", F.explode(F.array_distinct(F.array(first, last))).alias("chunk"))
    over = marked.where(last - first > 1).select(*key, "value", "lo", F.explode(F.sequence(first + 1, last - 1)).alias("chunk"))
    over = over.groupBy(*key, "chunk").agg(F.max_by("value", "lo").alias("value"), F.max("lo").alias("lo"))
    every = own.unionByName(over.withColumn("hi", (F.col("chunk") + 1) * size - 1))
    cut = every.select(*key, "chunk", "value", "lo", F.greatest("lo", F.col("chunk") * size).alias("start"), (F.least("hi", (F.col("chunk") + 1) * size - 1) + 1).alias("until"))
    one = lambda place, step: F.struct(F.col(place).alias("start"), F.lit(step).alias("step"))
    turns = cut.select(*key, "chunk", "value", "lo", F.explode(F.array(one("start", 1), one("until", -1))).alias("t")).select(*key, "chunk", "value", "lo", "t.*")
    places, order = W.partitionBy(*key, "chunk"), ["start", "step", "lo"]
    turns = turns.withColumns({"level": F.sum("step").over(places.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)), "next": F.lead("start").over(places.orderBy(*order))})
    begun = F.when(F.col("step") == 1, F.struct("value"))
    held = F.last(begun, ignorenulls=True).over(W.partitionBy(*key, "chunk", "level").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return turns.withColumn("held", held).where("level > 0 and next > start").select(*key, F.col("held.value").alias("value"), "start", (F.col("next") - 1).alias("end"))


def nearest_labelled(nodes: DataFrame, labels: DataFrame, missing: str | None = None) -> DataFrame:
    """(node, label) of the nearest labelled ancestor or node itself."""
    found = nearest(nodes, labels.select("node", F.col("label").alias("value"))).withColumnRenamed("value", "label")
    every = nodes.select("node").join(found, "node", "left")
    return every.withColumn("label", F.coalesce("label", F.lit(missing))) if missing is not None else every


def inherited_state(nodes: DataFrame, mutations: DataFrame) -> DataFrame:
    """(node, gene, pos, alt): the allele of the nearest ancestor or self that mutated there."""
    return nearest(placed(nodes), mutations.select("node", "gene", "pos", F.col("alt").alias("value")), ["gene", "pos"]).withColumnRenamed("value", "alt")


def last_ancestor_before(dated: DataFrame, cutoff: float) -> DataFrame:
    """As-of join along the tree: per tip after the cutoff, the last ancestor dated at
    or before it, the root if none is."""
    at = dated
    early = at.where(F.col("num_date") <= cutoff).select("node", F.col("node").alias("value"))
    tips = at.where(F.col("is_tip") & (F.col("num_date") > cutoff) & F.col("parent").isNotNull())
    roots = at.where("parent is null").select("tree_id", F.col("node").alias("root"))
    found = tips.select("tree_id", "node").join(nearest(at, early), "node", "left").join(roots, "tree_id")
    return found.select("node", F.coalesce("value", "root").alias("ancestor"))


def duplicate_names(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").count().where("count > 1")


def local_branching_index(nodes: DataFrame, tau: float, window: float, dates: str = "num_date", transform: Callable[[Column], Column] = lambda index: index) -> DataFrame:
    """(tree_id, node, lbi): exponentially weighted length of living branches around a
    node, over its greatest value in the tree; 0 where no value is positive.

    Branches count if any tip below was sampled within ``window`` of the tree's last date.
    What comes from below is a weighted sum up the tree, what comes from above a linear
    recurrence down it; ``transform`` is applied to the index before it is scaled.
    """
    tip = F.col("is_tip")
    last = nodes.groupBy("tree_id").agg(F.max(F.when(tip & ~F.isnan(dates), F.col(dates))).alias("_sm_last"))
    sampled = nodes.join(last, "tree_id").withColumn("_sm_alive", F.coalesce(tip & (F.col(dates) > F.col("_sm_last") - window), F.lit(False)).cast("long"))
    living = doubling.doubled(sampled, up={"living": (None, F.col("_sm_alive"))})
    length = F.coalesce(F.col("branch_length").cast("double"), F.lit(0.0))
    decay = F.exp(-length / tau)
    rows = nodes.select("tree_id", "node", "parent", decay.alias("decay"), (tau * (1 - decay)).alias("reach")).join(living, ["tree_id", "node"])
    rows = stored(rows.withColumn("own", F.when(F.col("living") > 0, F.col("reach")).otherwise(0.0)), "branching")
    # To its parent a node gives its own branch and, dampened by it, what its children give;
    # so what a child gives is dampened by its parent's branch.
    parents = rows.select("tree_id", F.col("node").alias("parent"), F.col("decay").alias("dampened"))
    given = doubling.doubled(rows.join(parents, ["tree_id", "parent"], "left"), up={"given": (F.coalesce("dampened", F.lit(1.0)), F.col("own"))})
    sums = rows.join(given, ["tree_id", "node"])
    below = sums.where("parent is not null").groupBy("tree_id", F.col("parent").alias("node")).agg(F.sum("given").alias("below"))
    sums = stored(sums.join(below, ["tree_id", "node"], "left").withColumn("below", F.coalesce("below", F.lit(0.0))), "branching")
    above = sums.select("tree_id", F.col("node").alias("parent"), F.col("below").alias("beside"))
    down = sums.join(above, ["tree_id", "parent"], "left")
    step = F.when(F.col("beside").isNull(), 0.0).otherwise((F.col("beside") - F.col("given")) * F.col("decay") + F.col("own"))
    taken = doubling.doubled(down, down={"taken": (F.col("decay"), step)})
    scored = sums.join(taken, ["tree_id", "node"]).withColumn("score", transform(F.col("taken") + F.col("below")))
    top = scored.groupBy("tree_id").agg(F.max("score").alias("top"))
    return scored.join(top, "tree_id").select("tree_id", "node", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("lbi"))


def branch_changes(nodes: DataFrame, states: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(node, label) where the state of a node differs from its parent's: ``A → B``;
    states below the confidence threshold are ``uncertain``."""
    shown = states.select("node", F.when(F.col("confidence") >= threshold, F.col("state")).otherwise("uncertain").alias("state"))
    child = nodes.where("parent is not null").select("node", "parent").join(shown, "node")
    above = shown.select(F.col("node").alias("parent"), F.col("state").alias("before"))
    return child.join(above, "parent").where("state <> before").select("node", F.concat_ws(" → ", "before", "state").alias("label"))


def unique_labels(labels: DataFrame) -> DataFrame:
    """Repeated labels get a number in node order."""
    own = W.partitionBy("label")
    rank, count = F.row_number().over(own.orderBy("node")), F.count(F.lit(1)).over(own)
    return labels.select("node", F.when(count > 1, F.concat_ws("_", "label", rank.cast("string"))).otherwise(F.col("label")).alias("label"))


def layout(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, y): tips by rank from the last in pre-order, inner nodes midway of
    their children's extremes.

    Subtrees hold runs of ranks, so the extremes are the first and the last child, and a
    node's height is a weighted sum up the tree: a half of both, all of an only child.
    """
    by = "pre" if "pre" in nodes.columns else "node"
    rows = _with_leaf(nodes.select("tree_id", "node", "parent", *({by} - {"node"})))
    leaves = doubling.doubled(rows, up={"leaves": (None, F.col("_sm_leaf"))})
    ranked = rows.join(leaves.hint("merge"), ["tree_id", "node"])
    own, every = W.partitionBy("tree_id", "parent").orderBy(by), W.partitionBy("tree_id", "parent")
    place, many = F.row_number().over(own), F.count(F.lit(1)).over(every)
    share = F.when(many == 1, 1.0).when((place == 1) | (place == many), 0.5).otherwise(0.0)
    ranked = stored(ranked.withColumns({"share": share, "ahead": _earlier(ranked, by, "leaves")}), "layout")
    before = doubling.doubled(ranked, down={"before": (None, F.col("ahead"))})
    total = ranked.groupBy("tree_id").agg(F.sum("_sm_leaf").alias("tips"))
    tips = ranked.join(before.hint("merge"), ["tree_id", "node"]).join(total, "tree_id")
    height = F.when(F.col("_sm_leaf") == 1, (F.col("tips") - F.col("before")).cast("double")).otherwise(0.0)
    return doubling.doubled(tips, up={"y": (F.col("share"), height)})


def path_between(paths: DataFrame, first: Column | str, second: Column | str) -> DataFrame:
    """Nodes on the way between two tips, the tips left out: the symmetric difference of
    their ancestor sets."""
    one = paths.where(F.col("desc") == first).select("anc")
    two = paths.where(F.col("desc") == second).select("anc")
    return one.exceptAll(two).unionByName(two.exceptAll(one)).where((F.col("anc") != first) & (F.col("anc") != second)).withColumnRenamed("anc", "node")


def reroot_records(records: list[dict], outgroup: str | None = None, drop: bool = False) -> list[dict]:
    """Node records rerooted on an outgroup's branch, or at the midpoint of the longest
    way between tips; ``drop`` removes the outgroup afterwards."""
    near: dict[str, dict[str, float]] = {r["name"]: {} for r in records}
    for r in records:
        if r["parent"] is not None:
            near[r["name"]][r["parent"]] = near[r["parent"]][r["name"]] = float(r.get("branch_length") or 0.0)

    def walk(start: str) -> dict[str, tuple[float, str | None]]:
        seen: dict[str, tuple[float, str | None]] = {start: (0.0, None)}
        stack = [start]
        while stack:
            node = stack.pop()
            for other, length in near[node].items():
                if other not in seen:
                    seen[other] = (seen[node][0] + length, node)
                    stack.append(other)
        return seen

    if outgroup is None:
        tips = [n for n, others in near.items() if len(others) == 1]
        a = max(walk(tips[0]).items(), key=lambda kv: (kv[0] in tips, kv[1][0]))[0]
        seen = walk(a)
        b = max((n for n in tips), key=lambda n: seen[n][0])
        half, node = seen[b][0] / 2, b
        while seen[node][0] > half and seen[node][1] is not None and seen[seen[node][1]][0] > half:
            node = seen[node][1]
        low, high, split = node, seen[node][1], seen[node][0] - half
    else:
        low = outgroup
        high = next(iter(near[outgroup]))
        split = near[outgroup][high] / 2
    length = near[low].pop(high)
    near[high].pop(low)
    near["_root"] = {low: split, high: length - split}
    near[low]["_root"], near[high]["_root"] = split, length - split
    if drop and outgroup is not None:
        near["_root"].pop(outgroup)
        near.pop(outgroup)
    seen = walk("_root")
    out = [{"name": n, "parent": p, "branch_length": near[n][p] if p is not None else 0.0} for n, (_, p) in seen.items()]
    return _collapsed(out)


def _collapsed(records: list[dict]) -> list[dict]:
    """Without inner nodes that have one child."""
    while True:
        children: dict[str | None, list[dict]] = {}
        for r in records:
            children.setdefault(r["parent"], []).append(r)
        lone = next((r for r in records if len(children.get(r["name"], [])) == 1), None)
        if lone is None:
            return records
        child = children[lone["name"]][0]
        child["parent"] = lone["parent"]
        child["branch_length"] = (child["branch_length"] + lone["branch_length"]) if lone["parent"] is not None else 0.0
        records = [r for r in records if r is not lone]


def nested(rows: list[dict], key: str = "name") -> dict:
    """A nested document of node rows (node, parent, ...) in pre-order."""
    made: dict[str, dict] = {}
    root: dict = {}
    for row in rows:
        item = {key: row["node"]} | {k: v for k, v in row.items() if k not in ("node", "parent") and v is not None}
        made[row["node"]] = item
        if row["parent"] is None:
            root = item
        else:
            made[row["parent"]].setdefault("children", []).append(item)
    return root


def descend(root: dict) -> Iterator[tuple[dict, dict | None]]:
    """(item, parent item) of a nested document in pre-order."""
    stack: list[tuple[dict, dict | None]] = [(root, None)]
    while stack:
        item, parent = stack.pop()
        yield item, parent
        stack += [(child, item) for child in reversed(item.get("children", []))]
