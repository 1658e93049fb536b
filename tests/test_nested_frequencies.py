"""Nested curves of sites and clades against fits by dense matrices."""

import random

import numpy as np
import pytest

from strandmill.operators import frequencies

PIVOTS = [2000.0, 2000.7, 2001.5, 2002.0, 2003.0]


def dense(series, order):
    """Curves by state from (date, state) observations, one dense fit after another."""
    grid, width = np.array(PIVOTS), (PIVOTS[-1] - PIVOTS[0]) / frequencies.CELLS
    snapped = [(PIVOTS[0] + (min(int((d - PIVOTS[0]) / width), frequencies.CELLS - 1) + 0.5) * width, s) for d, s in series if PIVOTS[0] <= d <= PIVOTS[-1]]
    left, out = np.ones(len(grid)), {}
    for state in order[:-1]:
        t, seen = np.array([d for d, _ in snapped]), np.array([s == state for _, s in snapped], float)
        out[state] = left * frequencies.diffusion_fit(t, seen, grid)
        left = left - out[state]
        snapped = [(d, s) for d, s in snapped if s != state]
    return out | {order[-1]: left}


def test_fits_at_once_are_the_single_fits():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 4, (30, frequencies.CELLS)).astype(float)
    k = np.floor(rng.random(n.shape) * (n + 1))
    grid = np.array(PIVOTS)
    t = grid[0] + (np.arange(n.shape[1]) + 0.5) * (grid[-1] - grid[0]) / n.shape[1]
    found = frequencies.diffusion_fits(n, k, grid, 15.0)
    for row in range(30):
        own = n[row] > 0
        want = frequencies.diffusion_fit(t[own], k[row][own] / n[row][own], grid, 15.0, weights=n[row][own])
        assert np.abs(found[row] - want).max() < 1e-6


def test_sites_of_an_alignment(spark):
    rng = random.Random(5)
    tips = [(f"t{i}", rng.choice("AAAC") + rng.choice("ACG-") + "A" + rng.choices("ACGT", [80, 15, 1, 1])[0], rng.uniform(1999.8, 2003.2)) for i in range(400)]
    rows = spark.createDataFrame([t[:2] for t in tips], "tip string, sequence string").repartition(3)
    dates = spark.createDataFrame([(t[0], t[2]) for t in tips], "tip string, num_date double")
    found = {}
    for r in frequencies.alignment_frequencies(rows, dates, PIVOTS, least=0.05, ignore="-").collect():
        found.setdefault((r["pos"], r["state"]), {})[r["pivot"]] = r["frequency"]
    for pos in (0, 1, 3):
        letters = [(d, "other" if pos == 3 and s[pos] in "GT" else s[pos]) for _, s, d in tips if s[pos] != "-"]
        states = sorted({s for _, s in letters}, key=lambda s: (-sum(x == s for _, x in letters), s))
        for state, curve in dense(letters, states).items():
            assert [found[pos, state][p] for p in PIVOTS] == pytest.approx(curve.tolist(), abs=1e-6)
    assert {p for p, _ in found} == {0, 1, 3}
    with_site = frequencies.alignment_frequencies(rows, dates, PIVOTS, least=0.05, include=[2], ignore="-").where("pos = 2").collect()
    assert {(r["state"], r["frequency"]) for r in with_site} == {("A", 1.0)}
    with pytest.raises(Exception, match="tip without a date: t9"):
        frequencies.alignment_frequencies(rows, dates.where("tip <> 't9'"), PIVOTS).collect()
    assert frequencies.alignment_frequencies(rows.limit(0), dates, PIVOTS).count() == 0


def test_clades_sum_up_to_their_parent(spark):
    rng = random.Random(8)
    parent = {0: None} | {i: rng.randrange(max(1, i // 2), i) if i > 4 else 0 for i in range(1, 160)}
    below = {i: [c for c, p in parent.items() if p == i] for i in parent}
    dates = {i: rng.uniform(1999.9, 2003.1) for i in parent if not below[i] and rng.random() < 0.9}
    leaves = {}
    for i in sorted(parent, reverse=True):
        leaves[i] = [i] * (i in dates) if not below[i] else [t for c in below[i] for t in leaves[c]]
    nodes = spark.createDataFrame([("t", f"{i:03d}", None if p is None else f"{p:03d}") for i, p in parent.items()], "tree_id string, node string, parent string")
    dated = spark.createDataFrame([(f"{i:03d}", d) for i, d in dates.items()], "node string, num_date double")
    found = {}
    for r in frequencies.nested_clade_frequencies(nodes, dated, PIVOTS, least_leaves=6).collect():
        found.setdefault(int(r["node"]), {})[r["pivot"]] = r["frequency"]
    want = {0: np.ones(len(PIVOTS))}
    for i in sorted(parent):
        children = [c for c in below[i] if leaves[c]]
        large = [c for c in children if len(leaves[c]) > 6]
        small = [c for c in children if c not in large]
        group = {c: f"{c:03d}" for c in large} | {c: f"{c:03d}" if len(small) == 1 else "" for c in small}
        if large:
            series = [(dates[t], group[c]) for c in children for t in leaves[c]]
            states = sorted(set(group.values()), key=lambda s: (-sum(x == s for _, x in series), s))
            curves = dense(series, states)
        for c in below[i]:
            if c not in group:
                want[c] = np.zeros(len(PIVOTS))
            elif not large:
                want[c] = want[i] * len(leaves[c]) / len(leaves[i])
            else:
                part = 1.0 if group[c] else len(leaves[c]) / sum(len(leaves[s]) for s in small)
                want[c] = want[i] * curves[group[c]] * part
    assert set(found) == set(parent)
    for i, curve in want.items():
        assert [found[i][p] for p in PIVOTS] == pytest.approx(curve.tolist(), abs=1e-6), i
        if any(leaves[c] for c in below[i]):
            assert [sum(found[c][p] for c in below[i]) for p in PIVOTS] == pytest.approx(curve.tolist(), abs=1e-9)
    assert frequencies.nested_clade_frequencies(nodes.limit(0), dated, PIVOTS).count() == 0
