"""Frequencies over time: kernel densities, alleles, pivots, and smoothing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandmill.operators import doubling
from strandmill.storage import stored

#: Bandwidths in years and the share of the wide one.
NARROW, WIDE, WIDE_SHARE = 1 / 12, 3 / 12, 0.2


def linear_pivots(start: float, end: float, interval: float) -> list[float]:
    """Evenly spaced decimal years that end at ``end``, four digits."""
    count = int(math.floor((end - start) / interval + 1e-9)) + 1
    return sorted(round(end - i * interval, 4) for i in range(count))


def normal_density(x: Column, mean: Column, deviation: float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / deviation, F.lit(2.0))) / (deviation * math.sqrt(2 * math.pi))


def kernel_density(pivot: Column, date: Column, narrow: float = NARROW, wide: float = WIDE, share: float = WIDE_SHARE) -> Column:
    """A narrow and a wide normal density around a date."""
    return (1 - share) * normal_density(pivot, date, narrow) + share * normal_density(pivot, date, wide)


def pivot_frame(spark: SparkSession, pivots: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(p),) for p in pivots], "pivot double")


def tip_frequencies(
    tips: DataFrame, pivots: list[float], max_date: float | None = None, weights: dict[str, float] | None = None, attribute: str | None = None, censored: bool = False
) -> DataFrame:
    """(tip, pivot, frequency) from (tip, num_date[, attribute]).

    Densities are normalised at each pivot. A tip counts only within the pivots
    and up to ``max_date``; ``censored`` also drops a tip at pivots before its
    date. With ``weights`` by attribute value, each value's tips share its
    weight among the values that occur.
    """
    last = pivots[-1] if max_date is None else max_date
    grid = pivot_frame(tips.sparkSession, pivots)
    counts = (F.col("num_date") >= pivots[0]) & (F.col("num_date") <= last)
    density = F.when(counts, kernel_density(F.col("pivot"), F.col("num_date"))).otherwise(0.0)
    if censored:
        density = F.when(F.col("pivot") >= F.col("num_date"), density).otherwise(0.0)
    rows = tips.crossJoin(F.broadcast(grid)).withColumn("density", density)
    if weights and attribute:
        present = rows.groupBy("pivot", attribute).agg(F.sum("density").alias("of_value"))
        share = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col(attribute))
        occurring = present.withColumn("share", F.when(F.col("of_value") > 0, share)).where("share is not null")
        total = occurring.groupBy("pivot").agg(F.sum("share").alias("all_shares"))
        factors = occurring.join(total, "pivot").select("pivot", attribute, (F.col("share") / F.col("all_shares") / F.col("of_value")).alias("factor"))
        return rows.join(F.broadcast(factors), ["pivot", attribute], "left").select("tip", "pivot", (F.col("density") * F.coalesce("factor", F.lit(0.0))).alias("frequency"))
    sums = rows.groupBy("pivot").agg(F.sum("density").alias("all"))
    return rows.join(F.broadcast(sums), "pivot").select("tip", "pivot", F.when(F.col("all") > 0, F.col("density") / F.col("all")).otherwise(0.0).alias("frequency"))


def clade_frequencies(frequencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, pivot, frequency): every node has the sum of its tips (tip, pivot, frequency)."""
    own = nodes.select("tree_id", "node", "parent")
    rows = own.join(frequencies.withColumnRenamed("tip", "node"), "node").select("tree_id", "node", "pivot", "frequency")
    return doubling.subtree_totals(own, rows, ["pivot"], ["frequency"]).select("node", "pivot", "frequency")


def site_frequencies(frequencies: DataFrame, letters: DataFrame) -> DataFrame:
    """(pos, base, pivot, frequency) over variable sites; ``letters`` is (tip, pos, base).

    Tips meet their letters by a merge join: a table of tips is small as a file, but not on the driver.
    """
    variable = letters.groupBy("pos").agg(F.count_distinct("base").alias("states")).where("states > 1").select("pos")
    return letters.join(variable, "pos").join(frequencies.hint("merge"), "tip").groupBy("pos", "base", "pivot").agg(F.sum("frequency").alias("frequency"))


def allele_frequencies(alignment: DataFrame, least: float = 0.0) -> DataFrame:
    """(pos, letter, frequency) of aligned sequences, without alleles rarer than ``least``."""
    letters = alignment.select(F.posexplode(F.split("sequence", "")).alias("pos", "letter"))
    counted = letters.groupBy("pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("pos"))
    return counted.select("pos", "letter", share.alias("frequency")).where(F.col("frequency") >= least)


def pivot_counts(observations: DataFrame, pivots: list[float], date: str = "num_date") -> DataFrame:
    """(pivot, n) of observations nearest each pivot: bins reach half a step each way,
    the last one closed."""
    step = pivots[1] - pivots[0] if len(pivots) > 1 else 1.0
    low = pivots[0] - step / 2
    place = F.floor((F.col(date) - low) / step).cast("int")
    place = F.when(F.col(date) == pivots[-1] + step / 2, len(pivots) - 1).otherwise(place)
    counted = observations.select(place.alias("place")).where(F.col("place").between(0, len(pivots) - 1)).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    grid = observations.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(pivots)], "place int, pivot double")
    return grid.join(counted, "place", "left").select("pivot", F.coalesce("n", F.lit(0)).alias("n"))


def running_average(rows: DataFrame, value: str, order: str, width: int, by: list[str] = ()) -> DataFrame:
    """Mean over a window of rows around each one, shorter at the ends."""
    half = width // 2
    span = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return rows.withColumn("running", F.avg(value).over(span.orderBy(order).rowsBetween(-half, half)))


def observation_cutoffs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """First and last observation, step from the one before and running total per group."""
    own = W.partitionBy(by).orderBy(order)
    whole = W.partitionBy(by)
    return rows.withColumns(
        {
            "first_seen": F.min(order).over(whole),
            "last_seen": F.max(order).over(whole),
            "step": F.col(value) - F.lag(value).over(own),
            "total": F.sum(value).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)),
        }
    )


def logit(p: Column, pseudo: float = 1e-3) -> Column:
    """Log odds with a pseudo-count at both ends."""
    return F.log((p + pseudo) / (1 - p + pseudo))


def inverse_logit(x: Column, pseudo: float = 1e-3) -> Column:
    odds = F.exp(x)
    return (odds * (1 + pseudo) - pseudo) / (1 + odds)


def clamped(p: Column, margin: float) -> Column:
    return F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))


def binomial_confidence(p: Column, n: Column) -> Column:
    """Standard error of a frequency from n counts, never zero."""
    return F.sqrt((1.0 / (1.0 + n) + p * (1 - p)) / (1.0 + n))


def diffusion_fit(times: np.ndarray, seen: np.ndarray, pivots: np.ndarray, stiffness: float = 20.0, rounds: int = 60, weights: np.ndarray | None = None) -> np.ndarray:
    """Frequencies at pivots of a 0/1 series by penalised likelihood.

    The log odds at the pivots are interpolated to the observations; squared
    steps between pivots are penalised by ``stiffness``. The problem is convex
    and solved by damped Newton steps. An observation with weight n counts as n
    observations, of which ``seen`` is the share that was seen.
    """
    n = len(pivots)
    if not len(times):
        return np.full(n, np.nan)
    weights = np.ones(len(times)) if weights is None else weights
    right = np.clip(np.searchsorted(pivots, times), 1, n - 1)
    share = np.clip((times - pivots[right - 1]) / (pivots[right] - pivots[right - 1]), 0, 1)
    basis = np.zeros((len(times), n))
    basis[np.arange(len(times)), right - 1] = 1 - share
    basis[np.arange(len(times)), right] += share
    steps = np.diff(np.eye(n), axis=0) / np.sqrt(np.diff(pivots))[:, None]
    penalty = stiffness * steps.T @ steps / 10 + 1e-4 * np.eye(n)
    x = np.zeros(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-basis @ x))
        gradient = basis.T @ (weights * (p - seen)) + penalty @ x
        hessian = (basis * (weights * p * (1 - p))[:, None]).T @ basis + penalty
        move = np.linalg.solve(hessian, gradient)
        x -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-x))


def diffusion_frequencies(observations: DataFrame, pivots: list[float], stiffness: float = 20.0) -> DataFrame:
    """(group, pivot, frequency) from (group, num_date, seen 0/1): one fit per group, whose
    observations are first counted on a fine grid, so a group's size is bounded. Each
    cell weighs as many observations as it has."""
    grid = np.array(pivots)
    fine = 200
    width = (pivots[-1] - pivots[0]) / fine

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        found = diffusion_fit(pdf["t"].to_numpy(), pdf["k"].to_numpy() / n, grid, stiffness, weights=n)
        return pd.DataFrame({"group": pdf["group"].iloc[0], "pivot": grid, "frequency": found})

    cell = F.floor((F.col("num_date") - pivots[0]) / width)
    counted = observations.where(F.col("num_date").between(pivots[0], pivots[-1])).groupBy("group", (pivots[0] + (cell + 0.5) * width).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("k"))
    return counted.groupBy("group").applyInPandas(fit, "group string, pivot double, frequency double")


#: Cells of the common time grid on which observations are counted, and fits solved at once.
CELLS, FITS_EACH = 200, 2000


def _cell(date: Column, pivots: list[float]) -> Column:
    """Place of a date on the grid between the first and the last pivot; -1 outside and for none."""
    width = (pivots[-1] - pivots[0]) / CELLS
    place = F.least(F.floor((date - pivots[0]) / width), F.lit(CELLS - 1)).cast("int")
    return F.when(date.between(pivots[0], pivots[-1]), place).otherwise(-1)


def diffusion_fits(n: np.ndarray, k: np.ndarray, pivots: np.ndarray, stiffness: float = 20.0, rounds: int = 60) -> np.ndarray:
    """``diffusion_fit`` of many series at once: frequencies by series and pivot.

    ``n`` and ``k`` are observations and seen ones by series and cell. An observation
    touches two neighbouring pivots, so every Newton system has three diagonals, and
    all series are solved together, pivot by pivot.
    """
    series, many = len(n), len(pivots)
    width = (pivots[-1] - pivots[0]) / n.shape[1]
    t = pivots[0] + (np.arange(n.shape[1]) + 0.5) * width
    right = np.clip(np.searchsorted(pivots, t), 1, many - 1)
    share = np.clip((t - pivots[right - 1]) / (pivots[right] - pivots[right - 1]), 0, 1)
    basis = np.zeros((n.shape[1], many))
    basis[np.arange(len(t)), right - 1] = 1 - share
    basis[np.arange(len(t)), right] += share
    squares, neighbours = basis**2, basis[:, :-1] * basis[:, 1:]
    pull = stiffness / 10 / np.diff(pivots)
    own = np.full(many, 1e-4)
    own[:-1] += pull
    own[1:] += pull
    x = np.zeros((series, many))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ basis.T))
        bent = x * own
        bent[:, :-1] -= pull * x[:, 1:]
        bent[:, 1:] -= pull * x[:, :-1]
        gradient = (n * p - k) @ basis + bent
        curve = n * p * (1 - p)
        move = _tridiagonal(curve @ squares + own, curve @ neighbours - pull, gradient)
        largest = np.abs(move).max(axis=1)
        x -= move * np.minimum(1.0, 2.0 / (largest + 1e-12))[:, None]
        if largest.max(initial=0.0) < 1e-8:
            break
    return 1 / (1 + np.exp(-x))


def _tridiagonal(main: np.ndarray, beside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric systems by row: elimination forwards, substitution backwards."""
    many = main.shape[1]
    ratio, out = np.empty_like(beside), np.empty_like(right)
    pivot = main[:, 0].copy()
    out[:, 0] = right[:, 0] / pivot
    for j in range(1, many):
        ratio[:, j - 1] = beside[:, j - 1] / pivot
        pivot = main[:, j] - beside[:, j - 1] * ratio[:, j - 1]
        out[:, j] = (right[:, j] - beside[:, j - 1] * out[:, j - 1]) / pivot
    for j in range(many - 2, -1, -1):
        out[:, j] -= ratio[:, j] * out[:, j + 1]
    return out


def nested_frequencies(counts: DataFrame, pivots: list[float], keys: list[str], state: str, stiffness: float = 20.0) -> DataFrame:
    """(keys, state, pivot, frequency) of states that exclude each other, summing up to one.

    ``counts`` is (keys, state, cell, n). The commonest state is fitted to all observations,
    the next one to those that are left, and so on; the rarest takes what remains. A group
    of keys is one row of states by cells, which its states bound, not its observations;
    many groups are fitted at once. Ties go by the state's name.
    """
    grid = np.array(pivots)
    per_state = counts.groupBy(*keys, state).agg(F.sum("n").alias("total"), F.collect_list(F.struct("cell", "n")).alias("cells"))
    groups = per_state.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("order"), F.col(state).alias("state"), "cells"))).alias("states"))
    numbered = groups.select(*keys, "states")
    schema = StructType([*[f for f in counts.schema.fields if f.name in keys], StructField(state, counts.schema[state].dataType), *StructType.fromDDL("pivot double, frequency double").fields])
    schema = StructType([schema[c] for c in [*keys, state, "pivot", "frequency"]])

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        at, n, k = [], [], []
        for row, states in enumerate(part["states"]):
            table = np.zeros((len(states), CELLS))
            for i, s in enumerate(states):
                for cell in s["cells"]:
                    if cell["cell"] >= 0:
                        table[i, cell["cell"]] += cell["n"]
            left = table.sum(axis=0)
            for i in range(len(states)):
                at.append((row, i))
                n.append(left)
                k.append(table[i])
                left = left - table[i]
        found = diffusion_fits(np.array(n), np.array(k), grid, stiffness)
        out = []
        for (row, i), own in zip(at, found, strict=True):
            states = part["states"].iloc[row]
            remaining = np.ones(len(grid)) if i == 0 else remaining
            curve = remaining if i == len(states) - 1 else remaining * own
            remaining = remaining - curve
            out.append(pd.DataFrame({**{c: [part[c].iloc[row]] * len(grid) for c in keys}, state: states[i]["state"], "pivot": grid, "frequency": curve}))
        return pd.concat(out, ignore_index=True)[schema.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, begin = pdf["states"].map(len).cumsum().to_numpy(), 0
            while begin < len(pdf):
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + FITS_EACH)))
                yield fitted(pdf.iloc[begin:end])
                begin = end

    return numbered.mapInPandas(run, schema)


def alignment_frequencies(alignment: DataFrame, dates: DataFrame, pivots: list[float], least: float = 0.01, include: list[int] = (), ignore: str = "", stiffness: float = 20.0) -> DataFrame:
    """(pos, state, pivot, frequency) of the letters of aligned sequences over time.

    ``alignment`` is (tip, sequence), ``dates`` (tip, num_date); a tip without a date fails
    the job. A 0-based place counts if the letters besides its commonest one are more than
    ``least`` of all sequences, or if it is in ``include``. Letters at most as frequent as
    ``least`` are one state, ``other``, unless there is only one of them. ``ignore`` is a
    letter for missing data, left out together with X. Dates outside the pivots count for
    these shares, not for curves.
    """
    dated = alignment.join(dates, "tip", "left")
    known = F.when(F.col("num_date").isNull() | F.isnan("num_date"), F.raise_error(F.concat(F.lit("tip without a date: "), F.col("tip").cast("string")))).otherwise(F.col("num_date"))
    letters = dated.select(_cell(known, pivots).alias("cell"), F.posexplode(F.split("sequence", "")).alias("pos", "letter"))
    counted = letters.groupBy("pos", "letter", "cell").agg(F.count(F.lit(1)).alias("n"))
    by_pos = W.partitionBy("pos")
    by_letter = counted.groupBy("pos", "letter").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(by_pos))
    if ignore:
        by_letter = by_letter.where(~F.col("letter").isin(ignore, "X"))
    ranked = by_letter.withColumns({"rank": F.row_number().over(by_pos.orderBy(F.desc("n"), "letter")), "minor": F.sum("share").over(by_pos) - F.max("share").over(by_pos)})
    wanted = F.col("pos").isin(list(include)) if include else F.lit(False)
    ranked = ranked.where((F.col("minor") > least) | wanted)
    named = (F.col("share") > least) | (F.col("rank") == 1) | wanted
    rare = F.sum((~named).cast("int")).over(by_pos)
    states = ranked.select("pos", "letter", F.when(named | (rare == 1), F.col("letter")).otherwise("other").alias("state"))
    counts = counted.join(states, ["pos", "letter"]).groupBy("pos", "state", "cell").agg(F.sum("n").alias("n"))
    return nested_frequencies(counts, pivots, ["pos"], "state", stiffness)


def nested_clade_frequencies(nodes: DataFrame, dates: DataFrame, pivots: list[float], least_leaves: int = 10, stiffness: float = 20.0) -> DataFrame:
    """(tree_id, node, pivot, frequency): children's curves sum up to their parent's, the root's is 1.

    ``nodes`` is (tree_id, node, parent), ``dates`` (node, num_date) of the tips that count;
    other tips have frequency 0. Children with more than ``least_leaves`` of them are fitted
    one after the other among their siblings. The others together are one more state and
    share its curve by their tips; where no child is that large, all share by their tips.
    Only the shares among siblings are fitted, all at once; the products of shares down
    the tree are a recurrence.
    """
    own = nodes.select("tree_id", "node", "parent")
    tips = own.join(dates.where("num_date is not null"), "node").select("tree_id", "node", _cell(F.col("num_date"), pivots).alias("cell"), F.lit(1).cast("long").alias("n"))
    cells = stored(doubling.subtree_totals(own, tips, ["cell"], ["n"]), "clades")
    totals = cells.groupBy("tree_id", "node").agg(F.sum("n").alias("leaves"))
    sibling = W.partitionBy("tree_id", "parent")
    children = own.where("parent is not null").join(totals, ["tree_id", "node"])
    large = F.col("leaves") > least_leaves
    children = children.withColumns({"small": F.sum((~large).cast("int")).over(sibling), "large": F.sum(large.cast("int")).over(sibling), "rest": F.sum(F.when(~large, F.col("leaves"))).over(sibling)})
    # Siblings that share a state, and their part of it.
    state = F.when(large | (F.col("small") == 1), F.col("node")).otherwise(F.lit(None).cast("string"))
    part = F.when(state.isNotNull(), 1.0).otherwise(F.col("leaves") / F.col("rest"))
    children = stored(children.select("tree_id", "node", "parent", state.alias("state"), part.alias("part"), (F.col("large") > 0).alias("fits")), "clades")
    counts = children.where("fits").join(cells, ["tree_id", "node"]).groupBy("tree_id", "parent", F.coalesce("state", F.lit("")).alias("state"), "cell").agg(F.sum("n").alias("n"))
    curves = nested_frequencies(counts, pivots, ["tree_id", "parent"], "state", stiffness)
    arrays = curves.groupBy("tree_id", "parent", "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("pivot", "frequency"))), lambda c: c["frequency"]).alias("curve"))
    shares = children.withColumn("state", F.coalesce("state", F.lit(""))).join(arrays, ["tree_id", "parent", "state"], "left").select("tree_id", "node", "part", "curve")
    rows = own.join(shares, ["tree_id", "node"], "left")
    each = {f"p{i}": F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce(F.col("part") * F.coalesce(F.col("curve")[i], F.lit(1.0)), F.lit(0.0))) for i in range(len(pivots))}
    start = F.when(F.col("parent").isNull(), 1.0).otherwise(0.0)
    found = doubling.doubled(rows, down={name: (share, start) for name, share in each.items()})
    spread = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("pivot"), F.col(f"p{i}").alias("frequency")) for i, p in enumerate(pivots)])).alias("at")
    return found.select("tree_id", "node", spread).select("tree_id", "node", "at.pivot", "at.frequency")
