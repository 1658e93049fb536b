"""Titer models from Gram tables against dense fits of measurements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import titers
from strandmill.plans.operator_queries import heap_nodes, sparse_measurements
from strandmill.plans.registry import Tables


def dense(x, y, names, method, main, potency, avidity):
    """Projected proximal gradient on the whole matrix, until nothing moves."""
    is_main = np.array([n.startswith(("branch:", "change:")) for n in names])
    ridge = np.where(is_main, main if method == "nnl2reg" else 0.0, np.where([n.startswith("potency:") for n in names], potency, avidity))
    lasso = np.where(is_main & (method in ("nnl1reg", "l1reg")), main / 2, 0.0)
    gram, pull = x.T @ x + np.diag(ridge), x.T @ y
    step, w = 1 / np.linalg.eigvalsh(gram)[-1], np.zeros(len(names))
    for _ in range(200_000):
        new = w - step * (gram @ w - pull)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        if method != "l1reg":
            new = np.where(is_main, np.maximum(new, 0), new)
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows, cells = [], []
    for t in range(14):
        for r in range(8):
            if rng.random() < 0.8:
                rows.append((f"v{t}", f"r{r}", "s", rng.gauss(1 + t / 10 - r / 10, 0.5)))
                cells += [(f"v{t}", f"r{r}", "s", f) for f in [f"potency:r{r}|s", f"avidity:v{t}", *[f"branch:b{b}" for b in range(9) if (t * 7 + r * 3) % (b + 2) == 0]]]
    key = "test string, ref string, serum string"
    return rows, cells, spark.createDataFrame(rows, f"{key}, value double").repartition(3), spark.createDataFrame(cells + cells[:5], f"{key}, feature string").repartition(3)


def as_matrix(rows, cells):
    names = sorted({c[3] for c in cells if any(c[:3] == r[:3] for r in rows)})
    x = np.zeros((len(rows), len(names)))
    at = {r[:3]: i for i, r in enumerate(rows)}
    for c in cells:
        if c[:3] in at:
            x[at[c[:3]], names.index(c[3])] = 1
    return x, np.array([r[3] for r in rows]), names


@pytest.mark.parametrize("method", ["nnls", "nnl1reg", "nnl2reg", "l1reg"])
def test_effects_against_dense_fits(model, method):
    rows, cells, measured, design = model
    settings = {"method": method, "main": 0.7, "potency": 0.4, "avidity": 0.3}
    found = {r["feature"]: r["effect"] for r in titers.fitted_effects(measured, design, **settings).collect()}
    x, y, names = as_matrix(rows, cells)
    assert found == {n: pytest.approx(v, abs=1e-5) for n, v in zip(names, dense(x, y, names, **settings), strict=True)}


def test_folds_against_refitting(model):
    rows, cells, measured, design = model
    folds = {r[:3]: r["fold"] for r in titers._folded(measured, 5, "folds").select("test", "ref", "serum", "fold").collect()}
    found = {r["fold"]: r for r in titers.cross_validated(measured, design, 5).collect()}
    assert sum(r["n"] for r in found.values()) == len(rows) and len(found) == 5
    for fold, errors in found.items():
        x, y, names = as_matrix([r for r in rows if folds[r[:3]] != fold], cells)
        w = dict(zip(names, dense(x, y, names, "nnl1reg", 1.0, 0.2, 0.1), strict=True))
        held = [r for r in rows if folds[r[:3]] == fold]
        guess = np.array([sum(w.get(c[3], 0.0) for c in cells if c[:3] == r[:3]) for r in held])
        off = guess - np.array([r[3] for r in held])
        assert errors["n"] == len(held)
        assert (errors["mean_absolute_error"], errors["root_mean_square_error"]) == (pytest.approx(np.abs(off).mean(), abs=1e-5), pytest.approx(np.sqrt((off**2).mean()), abs=1e-5))


def test_no_measurements(model):
    _, _, measured, design = model
    assert titers.fitted_effects(measured.limit(0), design).count() == 0
    assert titers.cross_validated(measured.limit(0), design).count() == 0


def test_some_branches_are_one_group(spark):
    nodes = heap_nodes(Tables(spark, "/root/testdata/sf0.01"))
    groups = titers.branch_groups(nodes, sparse_measurements(nodes))
    assert groups.select("group").distinct().count() < groups.count()
    measured = spark.createDataFrame([("c", "d", "s"), ("c", "d", "s"), ("x", "d", "s")], "test string, ref string, serum string")
    line = spark.createDataFrame([("t", "r", None), ("t", "a", "r"), ("t", "b", "a"), ("t", "c", "b"), ("t", "e", "b"), ("t", "d", "r")], "tree_id string, node string, parent string")
    assert {tuple(r) for r in titers.branch_groups(line, measured).collect()} == {("a", "a"), ("b", "a")}
    design = spark.createDataFrame([("c", "d", "s", f) for f in ("branch:a", "branch:b", "avidity:c", "branch:z")], "test string, ref string, serum string, feature string")
    found = titers.grouped_design(design, titers.branch_groups(line, measured))
    assert {r["feature"] for r in found.collect()} == {"branch:a", "branch:z", "avidity:c"} and found.count() == 3
    assert titers.branch_groups(line, measured.limit(0)).count() == 0 and groups.where(F.col("group") > F.col("node")).count() == 0


def test_titer_texts(spark):
    rows = spark.createDataFrame([("<40",), (">5120",), ("80",), ("none",)], "t string")
    assert [r[0] for r in rows.select(titers.parse_titer(F.col("t"))).collect()] == [20.0, 10240.0, 80.0, None]
