"""Grouped sampling: group keys, sizes per group, and top rows by priority.

Counts per group come from one aggregate. Sizes are worked out on the driver
over groups, which are few next to rows, and joined back; the rows of a group
are ranked by a window whose constant upper bound lets Spark prune each
partition before the shuffle.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import dates
from strandmill.operators import predicates

GENERATED = ("year", "month", "week")
#: Draws of sizes before an empty sample is accepted.
ATTEMPTS = 100


def group_keys(df: DataFrame, by: list[str], date_column: str = "date", today: dt.date = dt.date(2100, 1, 1)) -> DataFrame:
    """``df`` with a column ``group_<key>`` per key.

    year, month (YYYY-MM) and week (ISO) come from the date column; week excludes
    month and covers year; a column that is missing is ``unknown`` throughout.
    """
    if "week" in by and "month" in by:
        raise ValueError("month and week cannot be combined")
    if "week" in by:
        by = [key for key in by if key != "year"]
    known = [key for key in by if key in df.columns or (key in GENERATED and date_column in df.columns)]
    if by and not known:
        raise ValueError("none of the columns to group by exists")
    out = df
    if any(key in GENERATED for key in known):
        parts = dates.calendar_parts(F.col(date_column), today)
        out = out.withColumn("_sm_parts", parts)
    made: dict[str, Column] = {}
    for key in by:
        if key not in known:
            made[key] = F.lit("unknown")
        elif key == "year":
            made[key] = F.col("_sm_parts.year").cast("string")
        elif key == "month":
            made[key] = F.format_string("%04d-%02d", "_sm_parts.year", "_sm_parts.month")
        elif key == "week":
            made[key] = dates.iso_week(F.make_date("_sm_parts.year", "_sm_parts.month", "_sm_parts.day"))
        else:
            made[key] = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return out.withColumns({f"group_{key}": column for key, column in made.items()}).drop("_sm_parts")


#: Filters of rows whose dates are too vague to be grouped, by what is unknown: names are fixed values.
VAGUE = {"year": "skip_group_by_with_ambiguous_year", "month": "skip_group_by_with_ambiguous_month", "day": "skip_group_by_with_ambiguous_day"}


def grouping_filters(df: DataFrame, by: list[str], date_column: str = "date", today: dt.date = dt.date(2100, 1, 1)) -> list[predicates.Predicate]:
    """Filters that go before grouping by year, month or week: what a key needs must be known.

    They run from broad to specific, so that a row is named after the broadest part it
    lacks; grouping by other columns needs none.
    """
    finest = max((GENERATED.index(key) for key in by if key in GENERATED), default=-1)
    return [predicates.ambiguous_date(df, date_column, part, today, name) for part, name in list(VAGUE.items())[: finest + 1]]


def hashed_priority(id_column: str, seed: str | int) -> Column:
    """A repeatable random number in [0, 1) per id, whatever the row order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def top_per_group(df: DataFrame, by: list[str], size: Column | int, priority: Column, tie: list[Column], most: int | None = None) -> DataFrame:
    """Rows of highest priority per group; of equal ones the later in ``tie`` order.

    ``size`` may vary by row's group; ``most`` is then a constant upper bound.
    """
    order = [priority.desc(), *[t.desc() for t in tie]]
    ranked = df.withColumn("_sm_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    if isinstance(size, int):
        return ranked.where(F.col("_sm_rank") <= size).drop("_sm_rank")
    if most is not None:
        ranked = ranked.where(F.col("_sm_rank") <= most)
    return ranked.where(F.col("_sm_rank") <= size).drop("_sm_rank")


def top_rows(df: DataFrame, size: int, priority: Column, tie: list[Column]) -> DataFrame:
    """The rows of highest priority of the whole table; of equal ones the later in ``tie`` order."""
    return df.orderBy(priority.desc(), *[t.desc() for t in tie]).limit(size)


def largest_size(total: int, counts: list[int], groups: list[int]) -> int:
    """Largest rows per group whose sum stays within ``total``; ``total`` where all rows fit.

    Groups are used up from the smallest; the first that would overdraw what is left,
    if all groups above got as much, leaves an even share to the rest.
    """
    left, open_groups = total, sum(groups)
    for count, n in sorted(zip(counts, groups, strict=True)):
        if count * open_groups > left:
            return left // open_groups
        left, open_groups = left - count * n, open_groups - n
    return total


def even_size(total: int, counts: list[int], groups: list[int] | None = None) -> int:
    """Largest number of rows per group whose sum stays within ``total``; each count stands
    for as many ``groups`` (one by default)."""
    groups = [1] * len(counts) if groups is None else groups
    if total < sum(groups):
        raise ValueError("more groups than rows to keep")
    return largest_size(total, counts, groups)


def fractional_size(total: int, groups: int) -> float:
    """Mean rows per group where there are more groups than rows to keep."""
    return total / groups


def poisson_sizes(groups: list[tuple], mean: float, seed: int | None, attempts: int = 100) -> dict[tuple, int]:
    """Sizes drawn over sorted groups until any is positive; the last draw gives one
    group a row if all are zero."""
    import numpy as np

    rng = np.random.default_rng(seed)
    ordered = sorted(groups)
    for _ in range(attempts):
        sizes = rng.poisson(mean, len(ordered))
        if sizes.sum():
            return dict(zip(ordered, map(int, sizes), strict=True))
    return {group: int(i == 0) for i, group in enumerate(ordered)}


def weighted_sizes(counts: DataFrame, weights: DataFrame, columns: list[str], by: list[str], total: int, rounding: Column) -> DataFrame:
    """Sizes per group from weights: (group columns, n, weight, size).

    ``counts`` has ``group_<key>`` columns and n; ``weights`` has the weighted
    columns and weight, with ``default`` in all of them as a fallback. A weight
    is shared evenly by the groups that have its values, weights are normalised
    over the values that occur, and sizes are floor(share * total + rounding).
    Values without a weight fail the job where there is no fallback; weights
    whose values no group has are left out (``weight_gaps`` and
    ``unused_weights`` name both).
    """
    keys = [f"group_{key}" for key in by]
    weighted = [f"group_{key}" for key in columns]
    own, fallback = _split_weights(weights, columns)
    each = counts.groupBy(*weighted).agg(F.count(F.lit(1)).alias("_sm_peers")).join(own, weighted, "left").crossJoin(F.broadcast(fallback))
    named = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(f"group_{c}")) for c in columns])
    missing = F.raise_error(F.concat(F.lit("a group has no weight and there is no default: "), named)).cast("double")
    each = each.select(*weighted, "_sm_peers", F.coalesce("weight", "fallback", missing).alias("_sm_weight"))
    # The groups of a value share its weight, so the sum over values is that over groups.
    whole = each.agg(F.sum("_sm_weight").alias("_sm_whole"))
    rows = counts.join(each, weighted).crossJoin(F.broadcast(whole)).withColumn("weight", F.col("_sm_weight") / F.col("_sm_peers"))
    return rows.withColumn("size", F.floor(F.col("weight") / F.col("_sm_whole") * total + rounding).cast("int")).select(*keys, "n", "weight", "size")


def _split_weights(weights: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(weights of values with ``group_`` columns, one row with the fallback or null)."""
    default = reduce(lambda a, b: a & b, [F.col(c) == "default" for c in columns])
    own = weights.where(~default).select(*[F.col(c).alias(f"group_{c}") for c in columns], "weight")
    return own, weights.where(default).agg(F.max("weight").alias("fallback"))


def weight_gaps(counts: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value), each once: values of groups that no weight covers; only the fallback
    gives those groups a weight."""
    own, _ = _split_weights(weights, columns)
    bare = counts.join(own, [f"group_{c}" for c in columns], "left_anti")
    return distinct_values(bare, columns)


def distinct_values(counts: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of groups, each once."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"group_{c}").alias("value")) for c in columns])
    return counts.select(F.explode(cells).alias("cell")).select("cell.*").distinct()


def unused_weights(counts: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """Weights whose values no group has, the fallback aside."""
    own, _ = _split_weights(weights, columns)
    return own.join(counts, [f"group_{c}" for c in columns], "left_anti")


def skipped_groups(counts: DataFrame, weights: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row (possible, covered, skipped): groups that the weights' values and the values
    of the other columns could form, those of them that have rows, and the rest.

    The combinations are counted as a product of distinct values, never formed.
    """
    others = [key for key in by if key not in columns]
    own, _ = _split_weights(weights, columns)
    covered = counts.join(own, [f"group_{c}" for c in columns], "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    kinds = own.agg(F.count(F.lit(1)).alias("_sm_own"))
    values = counts.agg(F.lit(1).alias("_sm_one"), *[F.count_distinct(f"group_{key}").alias(f"_sm_{i}") for i, key in enumerate(others)])
    possible = reduce(lambda a, b: a * b, [F.col(f"_sm_{i}") for i in range(len(others))], F.col("_sm_own")).alias("possible")
    return values.crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(covered)).select(possible, "covered").withColumn("skipped", F.col("possible") - F.col("covered"))


def size_report(sizes: DataFrame) -> DataFrame:
    """Sizes per group with input_size (rows there are), target_size (rows wanted), output_size
    (rows taken) and under_sampled."""
    keys = [c for c in sizes.columns if c.startswith("group_")]
    return sizes.select(*[F.col(k).alias(k.removeprefix("group_")) for k in keys], "weight", F.col("n").alias("input_size"), F.col("size").alias("target_size"), F.least(F.col("n"), F.col("size").cast("long")).alias("output_size"), (F.col("n") < F.col("size")).alias("under_sampled"))


def sample_even(df: DataFrame, by: list[str], total: int, priority: Column, tie: list[Column], seed: int | None = None) -> DataFrame:
    """At most ``total`` rows, spread evenly over the groups (already keyed columns).

    One aggregate counts the groups; only the histogram of their sizes comes to
    the driver, so its size follows distinct counts, not groups. With more groups
    than rows, sizes are drawn from a Poisson law by a hash of the group, again
    where no group got a row.
    """
    sizes = df.groupBy(*by).count().groupBy("count").agg(F.count(F.lit(1)).alias("groups")).collect()
    groups = sum(r["groups"] for r in sizes)
    if not groups:
        return df
    if groups <= total:
        return top_per_group(df, by, even_size(total, [r["count"] for r in sizes], [r["groups"] for r in sizes]), priority, tie)
    mean = fractional_size(total, groups)
    # The mean is below 1 here, so the law ends after some twenty terms.
    law, cumulative = [], 0.0
    while cumulative < 1 - 1e-9:
        k = len(law)
        cumulative += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean > 0 else 1.0
        law.append(cumulative)
    for attempt in range(ATTEMPTS):
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"poisson:{seed}" + f":{attempt}" * bool(attempt)), *by)), 1, 8), 16, 10).cast("double") / 4294967296.0
        size = F.lit(len(law))
        for k in reversed(range(len(law))):
            size = F.when(draw < law[k], k).otherwise(size)
        if total == 0 or not df.where(size > 0).isEmpty():
            break
    return top_per_group(df, by, size, priority, tie, most=len(law))
