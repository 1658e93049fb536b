"""Recurrences along trees of any size and shape, by pointer doubling.

A tree is a table of nodes with their parents. Each round, every node looks at the node
that its pointer names, takes over what that one knows, and points where that one points;
so pointers reach twice as far from round to round, and a tree of depth d needs log2(d)
rounds of joins over all partitions, a chain of 300 000 nodes 19. Rounds are stored, and
join by merging: stored nodes are small as files, and broadcast each round they would all pass the driver.

* Down the tree: f(node) = b + a * f(parent), a and b given by node. Composed maps stay
  linear, so a node carries one a and one b for the whole stretch up to its pointer.
* Up the tree: s(node) = own + sum over children of w * s(child). A node that others
  point at adds up what they have, times the product of w on the stretch between.
* Toggles: sums up the tree that are exclusive ors of bits.
* Marks: the value of the nearest marked node on the way to the root, itself included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.storage import forget, stored

_KEY = ["tree_id", "node"]


def doubled(nodes: DataFrame, down: dict[str, tuple[Column | None, Column]] | None = None, up: dict[str, tuple[Column | None, Column]] | None = None, marks: dict[str, Column] | None = None, toggles: dict[str, Column] | None = None) -> DataFrame:
    """(tree_id, node, one column per recurrence) of nodes (tree_id, node, parent, ...).

    ``down`` maps a name to (a, b), ``up`` to (w, own), where None stands for 1; ``marks``
    to a value, null where a node has none; ``toggles`` to bits (long). A parent that is not in the table counts as
    none. Raises where nodes hang in a circle. Names of nodes must be unique in a tree.
    """
    down, up, marks, toggles = down or {}, up or {}, marks or {}, toggles or {}
    made = {f"a_{n}": a for n, (a, _) in down.items() if a is not None} | {f"b_{n}": b for n, (_, b) in down.items()}
    made |= {f"w_{n}": w for n, (w, _) in up.items() if w is not None} | {f"s_{n}": s for n, (_, s) in up.items()} | {f"m_{n}": m for n, m in marks.items()} | {f"x_{n}": x for n, x in toggles.items()}
    state = stored(nodes.select(*_KEY, F.col("parent").alias("jump"), *[column.alias(name) for name, column in made.items()]), "doubling")
    most = math.ceil(math.log2(max(state.count(), 1))) + 2
    for _ in range(most):
        if state.where("jump is not null").isEmpty():
            break
        after = stored(_round(state, down, up, marks, toggles), "doubling")
        forget(state)
        state = after
    else:
        raise ValueError("some nodes hang on no root")
    return state.select(*_KEY, *[F.col(f"b_{n}").alias(n) for n in down], *[F.col(f"s_{n}").alias(n) for n in up], *[F.col(f"m_{n}").alias(n) for n in marks], *[F.col(f"x_{n}").alias(n) for n in toggles])


def _round(state: DataFrame, down: dict, up: dict, marks: dict, toggles: dict) -> DataFrame:
    carried = [c for c in state.columns if c[:2] in ("a_", "b_", "w_", "m_")]
    above = state.select("tree_id", F.col("node").alias("jump"), F.col("jump").alias("next"), F.lit(True).alias("found"), *[F.col(c).alias(f"up_{c}") for c in carried])
    rows = state.join(above.hint("merge"), ["tree_id", "jump"], "left")
    if up or toggles:
        weighted = {n: F.col(f"s_{n}") * F.col(f"w_{n}") if w is not None else F.col(f"s_{n}") for n, (w, _) in up.items()}
        below = state.where("jump is not null").groupBy("tree_id", F.col("jump").alias("node")).agg(*[F.sum(c).alias(f"new_{n}") for n, c in weighted.items()], *[F.bit_xor(f"x_{n}").alias(f"flip_{n}") for n in toggles])
        rows = rows.join(below.hint("merge"), _KEY, "left")
    out: dict[str, Column] = {}
    for n, (a, _) in down.items():
        share = F.coalesce(F.col(f"up_b_{n}"), F.lit(0))
        out[f"b_{n}"] = F.col(f"b_{n}") + (F.col(f"a_{n}") * share if a is not None else share)
        if a is not None:
            out[f"a_{n}"] = F.when(F.col("found"), F.col(f"a_{n}") * F.col(f"up_a_{n}")).otherwise(F.col(f"a_{n}"))
    for n, (w, _) in up.items():
        out[f"s_{n}"] = F.col(f"s_{n}") + F.coalesce(F.col(f"new_{n}"), F.lit(0))
        if w is not None:
            out[f"w_{n}"] = F.when(F.col("found"), F.col(f"w_{n}") * F.col(f"up_w_{n}")).otherwise(F.col(f"w_{n}"))
    for n in toggles:
        out[f"x_{n}"] = F.col(f"x_{n}").bitwiseXOR(F.coalesce(F.col(f"flip_{n}"), F.lit(0).cast("long")))
    for n in marks:
        out[f"m_{n}"] = F.coalesce(f"m_{n}", f"up_m_{n}")
    kinds = dict(state.dtypes)
    return rows.select(*_KEY, F.col("next").alias("jump"), *[out[c].cast(kinds[c]).alias(c) for c in state.columns if c in out])


def subtree_totals(nodes: DataFrame, rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(tree_id, node, by, values): sums over a node's subtree, itself included, for each key
    ``by`` that occurs there. ``rows`` has tree_id, node, by and values, keys not null."""
    keys = [*_KEY, *by]
    pointers = stored(nodes.select(*_KEY, F.col("parent").alias("jump")), "doubling")
    totals = stored(rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]), "doubling")
    most = math.ceil(math.log2(max(pointers.count(), 1))) + 2
    for _ in range(most):
        active = pointers.where("jump is not null")
        if active.isEmpty():
            break
        moved = totals.join(active.hint("merge"), _KEY).select("tree_id", F.col("jump").alias("node"), *by, *values)
        ahead = stored(totals.select(*keys, *values).unionByName(moved).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]), "doubling")
        further = pointers.select("tree_id", F.col("node").alias("jump"), F.col("jump").alias("next"))
        onward = stored(pointers.join(further.hint("merge"), ["tree_id", "jump"], "left").select(*_KEY, F.col("next").alias("jump")), "doubling")
        forget(totals)
        forget(pointers)
        totals, pointers = ahead, onward
    else:
        raise ValueError("some nodes hang on no root")
    forget(pointers)
    # A parent that is not in the table may have gathered totals; it is no node.
    return totals.join(nodes.select(*_KEY), _KEY, "left_semi")
