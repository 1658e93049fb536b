"""Named samples as a graph of lazy tables, united into one selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import predicates, proximity, sampling

FILTER_KEYS = {"query", "exclude_where", "include_where", "min_date", "max_date", "group_by", "max_sequences", "group_size", "priority", "context_sample", "drop_sample"}
PROXIMAL_KEYS = {"focal_sample", "context_sample", "k", "max_distance", "missing", "drop_sample"}


@dataclass(frozen=True)
class Sample:
    """A named sample: a filter over the metadata or over another sample, or the
    neighbours of a focal sample in a context sample."""

    name: str
    options: dict = field(default_factory=dict)

    @property
    def proximal(self) -> bool:
        return "focal_sample" in self.options or len(self.options.keys() & PROXIMAL_KEYS) > len(self.options.keys() & FILTER_KEYS)

    @property
    def needs(self) -> list[str]:
        return [self.options[k] for k in ("context_sample", "focal_sample") if k in self.options]


def parse(config: dict) -> list[Sample]:
    """Samples of a configuration; filter samples inherit ``defaults``."""
    unknown = {k for o in config["samples"].values() for k in (o or {})} - FILTER_KEYS - PROXIMAL_KEYS
    if unknown:
        raise ValueError(f"unknown sample options: {sorted(unknown)}")
    defaults = config.get("defaults", {})
    samples = [Sample(name, dict(options or {})) for name, options in config["samples"].items()]
    return [s if s.proximal else Sample(s.name, defaults | s.options) for s in samples]


def ordered(samples: list[Sample]) -> list[Sample]:
    """Samples after what they need; raises on unknown names, cycles, or proximal
    samples that build on proximal ones."""
    by_name = {s.name: s for s in samples}
    for s in samples:
        for need in s.needs:
            if need not in by_name:
                raise ValueError(f"sample {s.name!r} refers to {need!r}, which does not exist")
            if s.proximal and by_name[need].proximal:
                raise ValueError(f"sample {s.name!r} needs filter samples, {need!r} is none")
    left, out, done = list(samples), [], set()
    while left:
        ready = [s for s in left if set(s.needs) <= done]
        if not ready:
            raise ValueError(f"samples form a cycle: {[s.name for s in left]}")
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s.name not in done]
    return out


def run(samples: list[Sample], metadata: DataFrame, id_column: str, sequences: DataFrame | None = None, date_column: str = "date", priorities: Callable | None = None) -> dict[str, DataFrame]:
    """Each sample's rows as a lazy table."""
    made: dict[str, DataFrame] = {}
    for sample in ordered(samples):
        o = sample.options
        if sample.proximal:
            if sequences is None:
                raise ValueError("proximal samples need sequences")
            rows = sequences.withColumnRenamed("id", id_column)
            focal = rows.join(made[o["focal_sample"]].select(id_column), id_column, "left_semi")
            context = rows.join(made[o["context_sample"]].select(id_column), id_column, "left_semi") if "context_sample" in o else rows
            near = proximity.neighbours(focal, context, o.get("k", 1), o.get("max_distance"), o.get("missing", "all"), id_column)
            made[sample.name] = metadata.join(near.select(id_column).distinct(), id_column, "left_semi")
            continue
        df = made[o["context_sample"]] if "context_sample" in o else metadata
        filters, includes = [], []
        for condition in _list(o.get("exclude_where")):
            filters.append(predicates.exclude_where(df, condition))
        if "query" in o:
            filters.append(predicates.by_query(df, o["query"]))
        if "min_date" in o:
            filters.append(predicates.min_date(o["min_date"], date_column))
        if "max_date" in o:
            filters.append(predicates.max_date(o["max_date"], date_column))
        by = _list(o.get("group_by"))
        filters += sampling.grouping_filters(df, by, date_column)
        for condition in _list(o.get("include_where")):
            includes.append(predicates.include_where(df, condition))
        marked = predicates.attributed(df, filters, includes)
        forced = marked.where(F.size("included") > 0).select(*df.columns)
        pool = marked.where(F.col("passed") & (F.size("included") == 0)).select(*df.columns)
        predicates.check_arguments(by, o.get("group_size"), o.get("max_sequences"), False)
        priority = priorities(sample) if priorities else sampling.hashed_priority(id_column, sample.name)
        if "group_size" in o or "max_sequences" in o:
            keyed = sampling.group_keys(pool, by, date_column) if by else pool.withColumn("group__", F.lit("all"))
            keys = [f"group_{k}" for k in by] or ["group__"]
            keys = [k for k in keys if k in keyed.columns]
            tie = [F.col(id_column)]
            pool = sampling.top_per_group(keyed, keys, o["group_size"], priority, tie) if "group_size" in o else sampling.sample_even(keyed, keys, o["max_sequences"], priority, tie)
        made[sample.name] = forced.unionByName(pool.select(*df.columns))
    return made


def united(samples: list[Sample], made: dict[str, DataFrame], metadata: DataFrame, id_column: str) -> DataFrame:
    """Metadata rows in any sample that is not dropped."""
    ids = [made[s.name].select(id_column) for s in samples if not s.options.get("drop_sample")]
    return metadata.join(reduce(DataFrame.unionAll, ids).distinct(), id_column, "left_semi")


def _list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, list | tuple) else [value]
