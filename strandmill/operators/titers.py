"""Antigenic titers: normalisation, design matrices, fits and their outputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandmill.operators import doubling
from strandmill.storage import stored


def parse_titer(text) -> F.col:
    """``<x`` is half of x, ``>x`` twice x, other text that is no number is null."""
    number = F.regexp_replace(text, "^[<>]", "").try_cast("double")
    return F.when(text.startswith("<"), number / 2).when(text.startswith(">"), number * 2).otherwise(number)


def read_titers(rows: DataFrame, excluded_sources: list[str] = ()) -> DataFrame:
    """(test, ref, serum, source, titer) from five text columns in that order."""
    named = rows.toDF("test", "ref", "serum", "source", "titer")
    kept = named.where(~F.col("source").isin(*excluded_sources)) if excluded_sources else named
    return kept.withColumn("titer", parse_titer(F.col("titer"))).where("titer is not null")


def restricted(titers: DataFrame, strains: DataFrame) -> DataFrame:
    """Measurements whose test and reference strains are both listed."""
    ids = strains.select(F.col(strains.columns[0]).alias("test")).distinct()
    return titers.join(ids, "test", "left_semi").join(ids.withColumnRenamed("test", "ref"), "ref", "left_semi").select(*titers.columns)


def strain_counts(titers: DataFrame) -> DataFrame:
    """Measurements per strain, as test or reference."""
    each = titers.select(F.explode(F.array_distinct(F.array("test", "ref"))).alias("strain"))
    return each.groupBy("strain").agg(F.count(F.lit(1)).alias("n"))


def census(titers: DataFrame) -> DataFrame:
    """Numbers of sera, reference and test strains, sources and pairs."""
    return titers.agg(
        F.count_distinct("ref", "serum").alias("sera"),
        F.count_distinct("ref").alias("references"),
        F.count_distinct("test").alias("tests"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct("test", "ref", "serum").alias("pairs"),
    )


def normalised(titers: DataFrame, most_sparse: int = 10) -> DataFrame:
    """(test, ref, serum, value): log2 distance to the serum's own titer.

    A serum's own titer is the mean of its autologous measurements. Without any,
    a serum with more than ``most_sparse`` pairs takes the 90th percentile of its
    pairs' medians; others are left out.
    """
    logged = titers.withColumn("log", F.log2("titer"))
    pairs = logged.groupBy("test", "ref", "serum").agg(F.avg("log").alias("mean"), F.median("log").alias("median"), F.count(F.lit(1)).alias("n"))
    own = logged.where("test = ref").groupBy("ref", "serum").agg(F.avg("log").alias("own"))
    other = pairs.groupBy("ref", "serum").agg(F.count(F.lit(1)).alias("pairs"), F.percentile("median", F.lit(0.9)).alias("high"))
    level = other.join(own, ["ref", "serum"], "left").select("ref", "serum", F.coalesce("own", F.when(F.col("pairs") > most_sparse, F.col("high"))).alias("level")).where("level is not null")
    return pairs.join(level, ["ref", "serum"]).select("test", "ref", "serum", (F.col("level") - F.col("mean")).alias("value"))


def tree_design(measured: DataFrame, paths: DataFrame) -> DataFrame:
    """(test, ref, serum, feature): the branches between test and reference tips of the
    tree, without the tips' own, plus one feature per serum and per test strain."""
    up = paths.where("steps > 0").select(F.col("desc").alias("tip"), F.col("anc").alias("branch"))
    pairs = measured.select("test", "ref", "serum")
    sides = pairs.join(up, pairs.test == up.tip).select("test", "ref", "serum", "branch").unionByName(pairs.join(up, pairs.ref == up.tip).select("test", "ref", "serum", "branch"))
    branches = sides.groupBy("test", "ref", "serum", "branch").count().where("count = 1").select("test", "ref", "serum", F.concat(F.lit("branch:"), "branch").alias("feature"))
    return branches.unionByName(_effects(pairs))


def _effects(pairs: DataFrame) -> DataFrame:
    return pairs.select("test", "ref", "serum", F.explode(F.array(F.concat(F.lit("potency:"), F.concat_ws("|", "ref", "serum")), F.concat(F.lit("avidity:"), "test"))).alias("feature"))


def branch_groups(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """(node, group): inner branches by the measurements that they separate, a group named
    after its first node; branches that separate none are left out.

    A measurement lies on both its tips with a random value of 192 bits. The exclusive or
    of a subtree cancels measurements that have both tips below, so it is a fingerprint
    of the set of those that the branch separates, whatever their order and number.
    Branches of equal sets cannot be told apart by any fit. Tips' own branches and the
    root are no features; measurements of tips that the tree lacks separate nothing there.
    """
    bits = [f"bits{i}" for i in range(3)]
    pairs = measured.select("test", "ref", "serum").distinct().where("test <> ref")
    name = F.struct("test", "ref", "serum")
    ends = pairs.select(F.explode(F.array("test", "ref")).alias("node"), *[F.xxhash64(F.lit(i), F.to_json(name)).alias(b) for i, b in enumerate(bits)])
    own = ends.groupBy("node").agg(*[F.bit_xor(b).alias(b) for b in bits])
    rows = nodes.select("tree_id", "node", "parent").join(own, "node", "left").na.fill(0, bits)
    found = doubling.doubled(rows, toggles={b: F.col(b) for b in bits})
    inner = nodes.where("parent is not null").select("tree_id", "node", "parent")
    parents = inner.select("tree_id", F.col("parent").alias("node")).distinct()
    branches = inner.join(parents, ["tree_id", "node"], "left_semi").join(found, ["tree_id", "node"]).where(" or ".join(f"{b} <> 0" for b in bits))
    named = branches.groupBy("tree_id", *bits).agg(F.min("node").alias("group"))
    return branches.join(named, ["tree_id", *bits]).select("node", "group")


def grouped_design(design: DataFrame, groups: DataFrame) -> DataFrame:
    """A tree design with one feature for each group of branches of equal measurements."""
    names = groups.select(F.concat(F.lit("branch:"), "node").alias("feature"), F.concat(F.lit("branch:"), "group").alias("_sm_group"))
    return design.join(names, "feature", "left").select("test", "ref", "serum", F.coalesce("_sm_group", "feature").alias("feature")).distinct()


def substitution_design(measured: DataFrame, sequences: DataFrame, least: int = 10) -> DataFrame:
    """(test, ref, serum, feature): substitutions from reference to test strain that more
    than ``least`` pairs show, plus the serum and strain effects."""
    from strandmill.functions.sequences import mutations

    pairs = measured.select("test", "ref", "serum")
    one = sequences.select(F.col("strain").alias("ref"), "gene", F.col("sequence").alias("a"))
    two = sequences.select(F.col("strain").alias("test"), "gene", F.col("sequence").alias("b"))
    changes = pairs.join(one, "ref").join(two, ["test", "gene"]).select("test", "ref", "serum", F.explode(mutations(F.col("a"), F.col("b"))).alias("change"), "gene")
    named = changes.select("test", "ref", "serum", F.concat_ws(":", F.lit("change"), "gene", "change").alias("feature"))
    common = named.groupBy("feature").count().where(F.col("count") > least).select("feature")
    return named.join(common, "feature").select("test", "ref", "serum", "feature").unionByName(_effects(pairs))


def collapse_collinear(design: DataFrame, threshold: int = 5) -> DataFrame:
    """(feature, group): changes whose columns differ in at most ``threshold`` measurements.

    In name order each change joins the first group whose first member it is that close
    to, or starts one; a group is named after its members. Columns are compared by their
    common measurements; the changes of one model come to the driver, as for its fit.
    """
    cells = design.where("feature like 'change:%'").select("feature", "test", "ref", "serum").distinct()
    sizes = dict(map(tuple, cells.groupBy("feature").count().collect()))
    other = cells.withColumnRenamed("feature", "other")
    both = cells.join(other, ["test", "ref", "serum"]).where("feature < other").groupBy("feature", "other").count()
    common = {(r["feature"], r["other"]): r["count"] for r in both.collect()}
    groups: list[list[str]] = []
    for name in sorted(sizes):
        near = (g for g in groups if sizes[name] + sizes[g[0]] - 2 * common.get((g[0], name), 0) <= threshold)
        group = next(near, None)
        if group is None:
            groups.append([name])
        else:
            group.append(name)
    rows = [(name, "/".join(group)) for group in groups for name in group]
    return design.sparkSession.createDataFrame(rows, "feature string, group string")


def _folded(measured: DataFrame, folds: int, seed: str) -> DataFrame:
    return measured.select("test", "ref", "serum", "value", F.floor(_draw(seed) * folds).cast("int").alias("fold"))


def gram(measured: DataFrame, design: DataFrame) -> DataFrame:
    """(fold, i, j, n, pull): what a least-squares fit needs of each fold's measurements.

    ``n`` counts the measurements that have both features, ``pull`` sums up the values of
    those that have feature i, on the diagonal. ``measured`` is (test, ref, serum, value,
    fold), ``design`` (test, ref, serum, feature). One aggregate over pairs of features of
    a measurement, which are as many as its path is long, squared.
    """
    key = ["test", "ref", "serum"]
    cells = design.where("feature is not null").select(*key, "feature").distinct()
    own = measured.select(*key, "value", "fold").join(cells.withColumnRenamed("feature", "i"), key)
    both = own.join(cells.withColumnRenamed("feature", "j"), key)
    value = F.when(F.col("i") == F.col("j"), F.col("value"))
    return both.groupBy("fold", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("pull"))


def without_fold(grams: DataFrame) -> DataFrame:
    """For each fold the Gram table of all others: the whole less the fold's own."""
    whole = grams.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("pull").alias("pull"))
    folds = grams.select("fold").distinct()
    # Folds are a handful of rows, one for each model to fit.
    every = whole.crossJoin(F.broadcast(folds))
    own = grams.select("fold", "i", "j", F.col("n").alias("own_n"), F.col("pull").alias("own_pull"))
    left = every.join(own, ["fold", "i", "j"], "left")
    rest = left.select("fold", "i", "j", (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n"), (F.col("pull") - F.coalesce("own_pull", F.lit(0.0))).alias("pull"))
    return rest.where("n > 0 or i = j")


def descent(features: list[str], i: np.ndarray, j: np.ndarray, n: np.ndarray, pull: np.ndarray, method: str = "nnl1reg", main: float = 1.0, potency: float = 0.2, avidity: float = 0.1, rounds: int = 20_000) -> np.ndarray:
    """Effects that minimise a penalised squared error, one coordinate after another.

    ``i``, ``j``, ``n`` are the Gram table's cells by place in ``features``, ``pull`` the
    diagonal's values. Main effects (branches or changes) are at least 0 and have an L1
    (nnl1reg, l1reg), L2 (nnl2reg) or no (nnls) penalty; l1reg leaves their signs free.
    Potencies and avidities are free with an L2 penalty.
    """
    many = len(features)
    is_main = np.array([f.startswith(("branch:", "change:")) for f in features], bool)
    ridge = np.where([f.startswith("potency:") for f in features], potency, avidity) * ~is_main
    if method == "nnl2reg":
        ridge = ridge + main * is_main
    lasso = np.where(is_main & (method in ("nnl1reg", "l1reg")), main / 2, 0.0)
    order = np.argsort(i, kind="stable")
    columns, values, first = j[order], n[order].astype(float), np.searchsorted(i[order], np.arange(many + 1))
    diagonal = np.zeros(many)
    diagonal[i[i == j]] = n[i == j]
    free = ~is_main | (method == "l1reg")
    w, left = np.zeros(many), pull.astype(float).copy()
    for _ in range(rounds):
        largest = 0.0
        for f in range(many):
            bent = diagonal[f] + ridge[f]
            if bent <= 0:
                continue
            target = left[f] + diagonal[f] * w[f]
            new = np.sign(target) * max(abs(target) - lasso[f], 0.0) / bent
            if not free[f]:
                new = max(new, 0.0)
            if new != w[f]:
                left[columns[first[f] : first[f + 1]]] -= values[first[f] : first[f + 1]] * (new - w[f])
                largest = max(largest, abs(new - w[f]))
                w[f] = new
        if largest < 1e-9:
            break
    return w


def fitted(grams: DataFrame, **settings) -> DataFrame:
    """(fold, feature, effect): one model per fold of a Gram table, each in a task of its own.

    A task has one model's table, whose size its features bound, not its measurements.
    """
    kind = grams.schema["fold"].dataType

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        features = sorted(set(pdf["i"]))
        place = {f: k for k, f in enumerate(features)}
        i, j = pdf["i"].map(place).to_numpy(), pdf["j"].map(place).to_numpy()
        pull = np.zeros(len(features))
        own = i == j
        pull[i[own]] = pdf["pull"].to_numpy(float)[own]
        effects = descent(features, i, j, pdf["n"].to_numpy(), pull, **settings)
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "feature": features, "effect": effects})

    return grams.groupBy("fold").applyInPandas(solve, StructType([StructField("fold", kind), *StructType.fromDDL("feature string, effect double").fields]))


def fitted_effects(measured: DataFrame, design: DataFrame, **settings) -> DataFrame:
    """(feature, effect) of one model over all measurements (test, ref, serum, value)."""
    return fitted(gram(measured.withColumn("fold", F.lit(0)), design), **settings).select("feature", "effect")


def cross_validated(measured: DataFrame, design: DataFrame, folds: int = 5, seed: str = "folds", **settings) -> DataFrame:
    """(fold, n, slope, intercept, r_squared, mean_absolute_error, root_mean_square_error).

    Measurements fall into folds by a hash. Each fold is predicted by a model of all
    others, whose Gram table is the whole one less the fold's own, so measurements are read
    once for all models. Features that the others lack have no effect.
    """
    rows = stored(_folded(measured, folds, seed), "folds")
    grams = stored(gram(rows, design), "gram")
    effects = fitted(without_fold(grams), **settings)
    key = ["test", "ref", "serum"]
    cells = rows.join(design.where("feature is not null").select(*key, "feature").distinct(), key, "left")
    guess = cells.join(effects, ["fold", "feature"], "left").groupBy("fold", *key).agg(F.first("value").alias("value"), F.sum(F.coalesce("effect", F.lit(0.0))).alias("predicted"))
    return guess.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *_errors(F.col("value"), F.col("predicted")))


def _draw(seed: str) -> Column:
    """A number in [0, 1) per measurement, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "test", "ref", "serum")), 1, 8), 16, 10).cast("double") / 4294967296.0


def train_test(measured: DataFrame, share: float = 0.9, seed: str = "split") -> tuple[DataFrame, DataFrame]:
    """A split by a hash of the pair, the same on every run."""
    marked = measured.withColumn("_sm_draw", _draw(seed))
    return marked.where(F.col("_sm_draw") < share).drop("_sm_draw"), marked.where(F.col("_sm_draw") >= share).drop("_sm_draw")


def predicted(design: DataFrame, effects: DataFrame) -> DataFrame:
    """(test, ref, serum, predicted): the sum of the effects of each pair's features."""
    return design.join(effects, "feature", "left").groupBy("test", "ref", "serum").agg(F.sum(F.coalesce("effect", F.lit(0.0))).alias("predicted"))


def validation(rows: DataFrame, actual: str = "value", guess: str = "predicted") -> DataFrame:
    """Slope, intercept, r squared, mean absolute and root mean square error."""
    return rows.agg(*_errors(F.col(actual), F.col(guess)))


def _errors(a: Column, p: Column) -> list[Column]:
    return [
        F.regr_slope(p, a).alias("slope"),
        F.regr_intercept(p, a).alias("intercept"),
        F.pow(F.corr(a, p), F.lit(2.0)).alias("r_squared"),
        F.avg(F.abs(a - p)).alias("mean_absolute_error"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("root_mean_square_error"),
    ]


def mean_potency(potencies: DataFrame) -> DataFrame:
    """(ref, mean): a reference strain's potency, its sera weighted by their counts."""
    return potencies.groupBy("ref").agg((F.sum(F.col("n") * F.col("potency")) / F.sum("n")).alias("mean_potency"))


def cumulative_effect(nodes: DataFrame, effects: DataFrame) -> DataFrame:
    """(node, total): the sum of branch effects (node, effect) from the root to a node, its own
    included; nodes without an effect add nothing."""
    rows = nodes.select("tree_id", "node", "parent").join(effects.select("node", "effect"), "node", "left")
    return doubling.doubled(rows, down={"total": (None, F.coalesce(F.col("effect").cast("double"), F.lit(0.0)))}).select("node", "total")


def compiled(measured: DataFrame) -> DataFrame:
    """(ref, titers): per reference a map from test strain and serum to value."""
    return measured.groupBy("ref").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("|", "test", "serum").alias("key"), F.round("value", 4).alias("value"))))).alias("titers"))


def pair_counts(changes: DataFrame, least: int = 10) -> DataFrame:
    """Changes that more than ``least`` pairs of strains show."""
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
