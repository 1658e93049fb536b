"""Mixing to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic) cell. The cells' weights are
raked in turn to the source, language and topic shares asked for. A cell's
sampling probability follows from its weight over its tokens, scaled to a token
budget with probabilities capped at one, and documents are drawn by a hash of
their id. DataFrame expressions only; ``mixing_sql`` says the same in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import named, stored, whole

DIMENSIONS = ("source", "lang", "topic")
#: What marks a topic in a text, in order of precedence; the rest is prose.
TOPIC_MARKS = (("table", " | "), ("shout", "!! "), ("noise", "*** "), ("legal", "Licen"))


@dataclass(frozen=True)
class Mixture:
    """Targets and budget. Languages and topics that are not listed get ``other``;
    shares are relative and hold among the values that occur. A source's share is
    its tokens to the power ``flatten``. ``budget`` is the share of all tokens to
    keep; ``cycles`` and ``fills`` are rounds of raking and of capping."""

    langs: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    topics: dict[str, float] = field(default_factory=lambda: {"prose": 0.75, "legal": 0.1, "table": 0.05, "shout": 0.05, "noise": 0.05})
    other: float = 0.02
    flatten: float = 0.7
    budget: float = 0.7
    cycles: int = 6
    fills: int = 4
    seed: str = "mix"


def _share(name: str, shares: dict[str, float], other: float) -> Column:
    column = F.lit(None).cast("double")
    for value, share in shares.items():
        column = F.coalesce(column, F.when(F.col(name) == value, F.lit(float(share))))
    return F.coalesce(column, F.lit(float(other)))


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with _sm_source, _sm_lang, _sm_topic, _sm_tokens and _sm_draw."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.lit("prose")
    for name, mark in reversed(TOPIC_MARKS):
        topic = F.when(F.instr(text, mark) > 0, name).otherwise(topic)
    return docs.withColumns(
        {
            "_sm_source": F.coalesce(F.col("source"), F.lit("")),
            "_sm_lang": F.coalesce(F.col("lang"), F.lit("")),
            "_sm_topic": topic,
            "_sm_tokens": (F.floor(F.octet_length(text) / 4) + 1).cast("double"),
        }
    )


def _raked(cells: DataFrame, name: str, targets: DataFrame) -> DataFrame:
    """Weights scaled so that ``name`` has its target shares."""
    sums = cells.groupBy(name).agg(F.sum("weight").alias("sum"))
    factors = sums.join(targets, name).select(name, (F.col("target") / F.col("sum")).alias("factor"))
    return cells.join(factors, name).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def mix(docs: DataFrame, mixture: Mixture = Mixture(), carry: bool = False) -> DataFrame:
    """``docs`` with topic, tokens, probability and kept; with ``carry`` the kept rows with
    their own columns only, whatever those are called.

    A null source or language is a value of its own, the empty one; a null text
    has no mark and one token. The draw depends on doc_id (on the text if that
    is null), so repeated rows share it. Columns with the results' names are
    replaced; an empty table gives no rows. Cells are few next to documents and
    are stored after every step, as plans that hold several steps name the cells
    once more for each and keep all their broadcasts on the driver; documents meet
    the cells in one join, broadcast when Spark finds the stored cells small enough.
    """
    rows = described(docs)
    cells = rows.groupBy(*[F.col(f"_sm_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_sm_tokens").alias("tokens"))
    cells = stored(cells.withColumn("weight", F.col("tokens")), "cells")
    shares = {"source": F.pow(F.sum("tokens"), F.lit(mixture.flatten)), "lang": F.first(_share("lang", mixture.langs, mixture.other)), "topic": F.first(_share("topic", mixture.topics, mixture.other))}
    targets = {}
    for name, share in shares.items():
        wanted = cells.groupBy(name).agg(share.alias("share"))
        total = wanted.agg(F.sum("share").alias("total"))
        targets[name] = stored(wanted.crossJoin(F.broadcast(total)).select(name, (F.col("share") / F.col("total")).alias("target")), "targets")
    for _ in range(mixture.cycles):
        for name in DIMENSIONS:
            cells = stored(_raked(cells, name, targets[name]).select(*DIMENSIONS, "tokens", "weight"), "cells")
    cells = cells.withColumn("ratio", F.col("weight") / F.col("tokens"))
    scale = stored(cells.agg((F.lit(mixture.budget) * F.sum("tokens") / F.sum("weight")).alias("scale")), "scale")
    for _ in range(mixture.fills):
        capped = F.col("scale") * F.col("ratio") >= 1
        full, free = F.sum(F.when(capped, F.col("tokens")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))
        budget = F.lit(mixture.budget) * F.sum("tokens") - full
        scale = stored(cells.crossJoin(F.broadcast(scale)).agg(F.when((free > 0) & (budget > 0), budget / free).otherwise(F.max("scale")).alias("scale")), "scale")
    chance = F.least(F.lit(1.0), F.col("scale") * F.col("ratio"))
    cells = stored(cells.crossJoin(F.broadcast(scale)).select(*[F.col(d).alias(f"_sm_{d}") for d in DIMENSIONS], F.round(chance, 9).alias("_sm_chance")), "chances")
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(mixture.seed + ":"), key)), 1, 8), 16, 10).cast("double") / 4294967296.0
    joined = rows.join(cells, [f"_sm_{d}" for d in DIMENSIONS])
    if carry:
        return joined.where(draw < F.col("_sm_chance")).select(*whole(docs))
    names = [named(name) for name in docs.columns if name.lower() not in ("topic", "tokens", "probability", "kept")]
    return joined.select(*names, F.col("_sm_topic").alias("topic"), F.col("_sm_tokens").cast("long").alias("tokens"), F.col("_sm_chance").alias("probability"), (draw < F.col("_sm_chance")).alias("kept"))


def _case(name: str, shares: dict[str, float], other: float) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {float(s)!r}::DOUBLE" for v, s in shares.items()) + f" ELSE {float(other)!r}::DOUBLE END"


def mixing_sql(mixture: Mixture = Mixture()) -> str:
    """DuckDB SQL for doc_id, topic, tokens, probability and kept of ``documents``."""
    topic = "CASE " + " ".join(f"WHEN instr(coalesce(text, ''), '{mark}') > 0 THEN '{name}'" for name, mark in TOPIC_MARKS) + " ELSE 'prose' END"
    steps = [
        f"d AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, (strlen(coalesce(text, '')) // 4 + 1)::DOUBLE AS tokens FROM documents)",
        "c0 AS (SELECT source, lang, topic, sum(tokens) AS tokens, sum(tokens) AS weight FROM d GROUP BY ALL)",
    ]
    wanted = {"source": f"pow(sum(tokens), {mixture.flatten!r})", "lang": f"min({_case('lang', mixture.langs, mixture.other)})", "topic": f"min({_case('topic', mixture.topics, mixture.other)})"}
    for name, share in wanted.items():
        steps.append(f"t_{name} AS (SELECT {name}, share / sum(share) OVER () AS target FROM (SELECT {name}, {share} AS share FROM c0 GROUP BY {name}))")
    at = 0
    for _ in range(mixture.cycles):
        for name in DIMENSIONS:
            steps.append(f"c{at + 1} AS (SELECT source, lang, topic, tokens, weight * target / sum(weight) OVER (PARTITION BY {name}) AS weight FROM c{at} JOIN t_{name} USING ({name}))")
            at += 1
    steps.append(f"s0 AS (SELECT {mixture.budget!r}::DOUBLE * sum(tokens) / sum(weight) AS scale FROM c{at})")
    for i in range(mixture.fills):
        capped = "scale * (weight / tokens) >= 1"
        full, free = f"sum(CASE WHEN {capped} THEN tokens ELSE 0 END)", f"sum(CASE WHEN {capped} THEN 0 ELSE weight END)"
        left = f"{mixture.budget!r}::DOUBLE * sum(tokens) - {full}"
        steps.append(f"s{i + 1} AS (SELECT CASE WHEN {free} > 0 AND {left} > 0 THEN ({left}) / {free} ELSE max(scale) END AS scale FROM c{at}, s{i})")
    steps.append(f"p AS (SELECT source, lang, topic, round(least(1.0, scale * (weight / tokens)), 9) AS probability FROM c{at}, s{mixture.fills})")
    draw = f"('0x' || substr(md5('{mixture.seed}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, topic, tokens::BIGINT AS tokens, probability, {draw} < probability AS kept FROM d JOIN p USING (source, lang, topic)"
