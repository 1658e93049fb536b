"""Recurrences along trees against walks, for chains, stars, bushes and forests."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import doubling, tree

NODES = "tree_id string, node string, parent string, branch_length double, is_tip boolean, pre int, num_date double"


def grown(n, shape, rng, tree_id="t"):
    """Node rows in pre-order of a random tree of a shape."""
    parent = [None] + [{"chain": i, "star": 0, "bush": rng.randrange(i + 1), "deep": max(0, i - rng.randrange(3))}[shape] for i in range(n - 1)]
    below = {}
    for i, p in enumerate(parent):
        below.setdefault(p, []).append(i)
    order, stack = {}, [0]
    while stack:
        i = stack.pop()
        order[i] = len(order)
        stack += reversed(below.get(i, []))
    name = lambda i: f"n{i:06d}"
    return [(tree_id, name(i), None if p is None else name(p), round(rng.random(), 3), i not in below, order[i], 2000 + rng.random() * 5) for i, p in enumerate(parent)]


@pytest.mark.parametrize("shape, n", [("chain", 70), ("star", 40), ("bush", 120), ("deep", 90), ("bush", 1)])
def test_places_against_one_walk(spark, shape, n):
    rng = random.Random(n)
    rows = grown(n, shape, rng) + grown(n // 2 + 1, "bush", rng, "u")
    nodes = spark.createDataFrame(rows, NODES)
    keyed = lambda df: {(r["tree_id"], r["node"]): (r["depth"], r["lo"], r["hi"], r["leaves"], pytest.approx(r["div"])) for r in df.collect()}
    assert keyed(tree.placed(nodes)) == keyed(tree.placed_each(nodes))
    low = keyed(tree.placed(nodes.drop("pre")))
    assert low == keyed(tree.placed_each(nodes.drop("pre")))


def test_index_and_heights_against_recurrences(spark):
    rows = grown(150, "bush", random.Random(7))
    tau, window = 0.3, 2.0
    by_name = {r[1]: r for r in rows}
    below = {r[1]: [c for c in rows if c[2] == r[1]] for r in rows}
    order = sorted(rows, key=lambda r: r[5])
    last = max(r[6] for r in rows if r[4])
    alive, given, taken, y = {}, {}, {}, {}
    for r in reversed(order):
        alive[r[1]] = (r[4] and r[6] > last - window) or any(alive[c[1]] for c in below[r[1]])
        own = tau * (1 - math.exp(-r[3] / tau)) * alive[r[1]]
        given[r[1]] = own + math.exp(-r[3] / tau) * sum(given[c[1]] for c in below[r[1]])
        y[r[1]] = 1.0 + sum(t[4] and t[5] > r[5] for t in rows) if r[4] else (max(y[c[1]] for c in below[r[1]]) + min(y[c[1]] for c in below[r[1]])) / 2
    for r in order:
        own = tau * (1 - math.exp(-r[3] / tau)) * alive[r[1]]
        beside = None if r[2] is None else taken[r[2]] + sum(given[c[1]] for c in below[r[2]] if c[1] != r[1])
        taken[r[1]] = 0.0 if r[2] is None else beside * math.exp(-r[3] / tau) + own
    score = {n: taken[n] + sum(given[c[1]] for c in below[n]) for n in by_name}
    top = max(score.values())
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    found = {r["node"]: r["lbi"] for r in tree.local_branching_index(nodes, tau, window).collect()}
    assert found == {n: pytest.approx(v / top, abs=1e-9) for n, v in score.items()}
    assert {r["node"]: r["y"] for r in tree.layout(nodes).collect()} == {n: pytest.approx(v) for n, v in y.items()}


def test_totals_by_key(spark):
    rows = grown(80, "deep", random.Random(3))
    nodes = spark.createDataFrame(rows, NODES)
    tips = nodes.where("is_tip").select("tree_id", "node", (F.col("pre") % 3).alias("k"), F.lit(2).alias("n"))
    up = {r[1]: r[2] for r in rows}
    want = {}
    for r in rows:
        if r[4]:
            at = r[1]
            while at is not None:
                want[at, r[5] % 3] = want.get((at, r[5] % 3), 0) + 2
                at = up[at]
    assert {(r["node"], r["k"]): r["n"] for r in doubling.subtree_totals(nodes, tips, ["k"], ["n"]).collect()} == want


def test_odd_trees(spark):
    circle = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "b", "a", 1.0), ("t", "c", None, 1.0)], "tree_id string, node string, parent string, branch_length double")
    with pytest.raises(ValueError, match="hang on no root"):
        tree.placed(circle)
    stray = spark.createDataFrame([("t", "a", "nowhere", None), ("t", "b", "a", None)], circle.schema)
    assert [(r["node"], r["depth"], r["lo"], r["leaves"], r["div"]) for r in tree.placed(stray).orderBy("node").collect()] == [("a", 0, 0, 1, 0.0), ("b", 1, 1, 1, 0.0)]
    assert tree.placed(circle.limit(0)).count() == 0 and tree.layout(circle.limit(0)).count() == 0


@pytest.mark.parametrize("parent", ["id - 1", "cast(floor(id / 2) as long)"])
def test_large_trees_spread_over_partitions(spark, parent):
    n = 60_000
    nodes = spark.range(1, n + 1).selectExpr("'t' as tree_id", "cast(id as string) as node", f"case when id > 1 then cast({parent} as string) end as parent", "1.0D as branch_length")
    found = tree.cumulative_divergence(nodes)
    assert found.rdd.getNumPartitions() > 1
    top = n - 1 if parent == "id - 1" else int(math.log2(n))
    assert found.agg(F.max("div"), F.count("node")).first()[:] == (top, n)
    assert tree.leaf_counts(nodes).agg(F.max("leaves")).first()[0] == (1 if parent == "id - 1" else n // 2)


@pytest.mark.parametrize("shape, n, chunk", [("chain", 40, 4), ("bush", 90, 8), ("deep", 80, 5), ("star", 30, 4), ("bush", 60, 65536)])
def test_states_of_keys_against_walks(spark, monkeypatch, shape, n, chunk):
    """Intervals are cut into chunks; no rows of a key leave the JVM in one group."""
    monkeypatch.setattr(tree, "CHUNK_PLACES", chunk)
    rng = random.Random(n)
    rows = grown(n, shape, rng)
    names = [r[1] for r in rows]
    marks = {(name, "g", pos): rng.choice("ACGT") for pos in (1, 2, 3) for name in rng.sample(names, (n // 2, n // 5, 2)[pos - 1])}
    found = tree.inherited_state(spark.createDataFrame(rows, NODES), spark.createDataFrame([(*k, v) for k, v in marks.items()], "node string, gene string, pos int, alt string"))
    up, want = {r[1]: r[2] for r in rows}, {}
    for pos in (1, 2, 3):
        for name in names:
            at = name
            while at is not None and (at, "g", pos) not in marks:
                at = up[at]
            if at is not None:
                want[name, pos] = marks[at, "g", pos]
    got = found.collect()
    assert len(got) == len(want) and {(r["node"], r["pos"]): r["alt"] for r in got} == want
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_rounds_send_no_nodes_to_the_driver(spark):
    nodes = spark.createDataFrame(grown(50, "bush", random.Random(3)), NODES)
    state = nodes.select("tree_id", "node", F.col("parent").alias("jump"), F.lit(1.0).alias("s_n"), F.lit(1.0).alias("b_d"))
    one = (None, F.lit(1.0))
    df = doubling._round(state, {"d": one}, {"n": one}, {}, {})
    assert df.count() == 50
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
