"""Frequencies, titers and their fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandmill.functions.dates import decimal_year
from strandmill.operators import clades, frequencies, titers
from strandmill.plans.registry import query
from strandmill.plans.sequence_queries import part_sequences
from strandmill.plans.tree_queries import heap_nodes

_EVENT_DATE = "(year(ts) + (dayofyear(ts) - 0.5) / dayofyear(make_date(year(ts), 12, 31)))"
PIVOTS = [2023.0, 2023.5, 2024.0, 2024.5, 2025.0]


def _density(pivot: str, date: str, deviation: str) -> str:
    return f"exp(-0.5::DOUBLE * pow(({pivot} - {date}) / ({deviation}), 2)) / (({deviation}) * {math.sqrt(2 * math.pi)!r}::DOUBLE)"


def _pivots() -> str:
    return "p(pv) AS (VALUES " + ", ".join(f"({p!r}::DOUBLE)" for p in PIVOTS) + ")"


def all_events(tables):
    """Every dated event as a tip."""
    day = F.to_date("ts")
    return tables("events").where("ts is not null").select(F.col("event_id").alias("tip"), decimal_year(day).alias("num_date"), "event_type")


_EVENTS = f"t AS (SELECT event_id AS tip, {_EVENT_DATE} AS num_date, event_type FROM events WHERE ts IS NOT NULL)"
_KERNEL = f"0.8::DOUBLE * {_density('pv', 'num_date', '1.0::DOUBLE / 12')} + 0.2::DOUBLE * {_density('pv', 'num_date', '3.0::DOUBLE / 12')}"


@query("kde_frequencies", f"WITH {_EVENTS}, {_pivots()}, d AS (SELECT tip, pv, CASE WHEN num_date BETWEEN {PIVOTS[0]!r} AND {PIVOTS[-1]!r} THEN {_KERNEL} ELSE 0 END AS density FROM t, p) SELECT tip, pv AS \"pivot\", round(CASE WHEN sum(density) OVER (PARTITION BY pv) > 0 THEN density / sum(density) OVER (PARTITION BY pv) ELSE 0 END, 9) AS frequency FROM d")
def kde_frequencies(spark, tables):
    return frequencies.tip_frequencies(all_events(tables), PIVOTS).withColumn("frequency", F.round("frequency", 9))


@query(
    "kde_weighted",
    f"""WITH {_EVENTS}, {_pivots()}, d AS (SELECT tip, event_type, pv, CASE WHEN num_date BETWEEN {PIVOTS[0]!r} AND {PIVOTS[-1]!r} THEN {_KERNEL} ELSE 0 END AS density FROM t, p),
    w AS (SELECT *, CASE event_type WHEN 'click' THEN 3.0::DOUBLE WHEN 'view' THEN 1.0::DOUBLE END AS share FROM d), g AS (SELECT pv, event_type, sum(density) AS s, max(share) AS share FROM w GROUP BY ALL),
    f AS (SELECT pv, event_type, share / sum(share) OVER (PARTITION BY pv) / s AS factor FROM g WHERE share IS NOT NULL AND s > 0)
    SELECT tip, pv AS "pivot", round(density * coalesce(factor, 0), 9) AS frequency FROM w LEFT JOIN f USING (pv, event_type)""",
)
def kde_weighted(spark, tables):
    found = frequencies.tip_frequencies(all_events(tables), PIVOTS, weights={"click": 3.0, "view": 1.0}, attribute="event_type")
    return found.withColumn("frequency", F.round("frequency", 9))


@query("pivot_counts", f"WITH {_pivots()} SELECT pv AS \"pivot\", count(d) AS n FROM p LEFT JOIN (SELECT {_EVENT_DATE} AS d FROM events) ON d >= pv - 0.25 AND (d < pv + 0.25 OR (pv = {PIVOTS[-1]!r} AND d = pv + 0.25)) GROUP BY 1")
def pivot_counts(spark, tables):
    rows = tables("events").select(decimal_year(F.to_date("ts")).alias("num_date"))
    return frequencies.pivot_counts(rows, PIVOTS)


@query("running_average", "WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS running FROM d")
def running_average(spark, tables):
    counted = tables("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return frequencies.running_average(counted, "n", "day", 5).select("day", F.round("running", 9).alias("running"))


@query("frequency_confidence", "SELECT event_type, round(sqrt((1.0::DOUBLE / (1 + n) + p * (1 - p)) / (1 + n)), 9) AS error, round(ln((p + 0.001::DOUBLE) / (1 - p + 0.001::DOUBLE)), 9) AS log_odds FROM (SELECT event_type, count(*)::DOUBLE AS n, count(*) / (SELECT count(*) FROM events)::DOUBLE AS p FROM events GROUP BY 1)")
def frequency_confidence(spark, tables):
    events = tables("events")
    total = events.agg(F.count(F.lit(1)).alias("all"))
    rows = events.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n")).crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("all")
    return rows.select("event_type", F.round(frequencies.binomial_confidence(p, F.col("n")), 9).alias("error"), F.round(frequencies.logit(p), 9).alias("log_odds"))


@query("confidence_entropy", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS p FROM c) SELECT user_id AS node, round(-sum(p * ln(p + 1e-12::DOUBLE)), 8) AS entropy FROM p GROUP BY 1")
def confidence_entropy(spark, tables):
    from pyspark.sql import Window as W

    counted = tables("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("user_id"))
    found = clades.confidence_entropy(counted.select(F.col("user_id").alias("node"), F.col("event_type").alias("state"), share.alias("p")))
    return found.select("node", F.round("entropy", 8).alias("entropy"))


def measured(tables):
    """Titers from line items: test strain, reference strain, serum, quantity."""
    row = tables("lineitem")
    test, ref = F.concat(F.lit("v"), F.col("l_partkey") % 50), F.concat(F.lit("v"), F.col("l_suppkey") % 40)
    return row.select(test.alias("test"), ref.alias("ref"), (F.col("l_linenumber") % 3).cast("string").alias("serum"), F.col("l_returnflag").alias("source"), F.col("l_quantity").cast("double").alias("titer"))


_TITERS = "t AS (SELECT 'v' || l_partkey % 50 AS test, 'v' || l_suppkey % 40 AS ref, (l_linenumber % 3)::VARCHAR AS serum, log2(l_quantity::DOUBLE) AS log FROM lineitem)"


@query("titer_normalize", f"WITH {_TITERS}, p AS (SELECT test, ref, serum, avg(log) AS mean, median(log) AS med FROM t GROUP BY ALL), o AS (SELECT ref, serum, avg(log) AS own FROM t WHERE test = ref GROUP BY ALL), l AS (SELECT p.ref, p.serum, coalesce(max(own), CASE WHEN count(*) > 10 THEN quantile_cont(med, 0.9) END) AS level FROM p LEFT JOIN o ON p.ref = o.ref AND p.serum = o.serum GROUP BY ALL) SELECT test, ref, serum, round(level - mean, 8) AS value FROM p JOIN l USING (ref, serum) WHERE level IS NOT NULL")
def titer_normalize(spark, tables):
    return titers.normalised(measured(tables)).withColumn("value", F.round("value", 8))


@query("titer_census", "SELECT count(DISTINCT (l_suppkey % 40, l_linenumber % 3)) AS sera, count(DISTINCT l_suppkey % 40) AS \"references\", count(DISTINCT l_partkey % 50) AS tests, count(DISTINCT l_returnflag) AS sources, count(DISTINCT (l_partkey % 50, l_suppkey % 40, l_linenumber % 3)) AS pairs FROM lineitem")
def titer_census(spark, tables):
    return titers.census(measured(tables))


@query("titer_parse", "SELECT l_linenumber, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN l_quantity / 2.0::DOUBLE WHEN 1 THEN l_quantity * 2.0::DOUBLE ELSE l_quantity::DOUBLE END AS titer, count(*) AS n FROM lineitem GROUP BY ALL")
def titer_parse(spark, tables):
    sign = F.when(F.col("l_linenumber") % 3 == 0, "<").when(F.col("l_linenumber") % 3 == 1, ">").otherwise("")
    text = F.concat(sign, F.col("l_quantity").cast("string"))
    return tables("lineitem").groupBy("l_linenumber", "l_quantity", titers.parse_titer(text).alias("titer")).agg(F.count(F.lit(1)).alias("n"))


@query("titer_validation", "WITH p AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE / 1000 AS b FROM lineitem) SELECT round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 5) AS intercept, round(corr(a, b) * corr(a, b), 7) AS r_squared, round(avg(abs(a - b)), 6) AS mean_absolute_error, round(sqrt(avg((a - b) * (a - b))), 6) AS root_mean_square_error FROM p")
def titer_validation(spark, tables):
    rows = tables("lineitem").select(F.col("l_quantity").cast("double").alias("value"), (F.col("l_extendedprice").cast("double") / 1000).alias("predicted"))
    digits = {"slope": 6, "intercept": 5, "r_squared": 7, "mean_absolute_error": 6, "root_mean_square_error": 6}
    return titers.validation(rows).select(*[F.round(n, d).alias(n) for n, d in digits.items()])


@query("titer_nnls", None)
def titer_nnls(spark, tables):
    """Strain and serum effects of the normalised titers, as (feature, effect)."""
    found = titers.normalised(measured(tables))
    return titers.fitted_effects(found, titers._effects(found.select("test", "ref", "serum")), method="nnls")


@query("titer_cross_validation", None)
def titer_cross_validation(spark, tables):
    """Errors of five folds of the normalised titers under models of the other four."""
    found = titers.normalised(measured(tables))
    return titers.cross_validated(found, titers._effects(found.select("test", "ref", "serum")))


@query("titer_mean_potency", "SELECT 's' || l_suppkey AS ref, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean_potency FROM lineitem GROUP BY 1")
def titer_mean_potency(spark, tables):
    rows = tables("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("ref"), F.col("l_quantity").alias("n"), F.col("l_extendedprice").alias("potency"))
    return titers.mean_potency(rows).select("ref", F.round("mean_potency", 4).alias("mean_potency"))


@query("diffusion_frequencies", None)
def diffusion_frequencies(spark, tables):
    rows = tables("events").select(F.lit("click").alias("group"), decimal_year(F.to_date("ts")).alias("num_date"), (F.col("event_type") == "click").cast("int").alias("seen"))
    return frequencies.diffusion_frequencies(rows, PIVOTS)


def part_dates(tables):
    """Decimal year of each part's first shipment."""
    first = tables("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.to_date(F.min("l_shipdate")).alias("day"))
    return tables("part").join(first, "p_partkey").select(F.col("p_partkey").cast("string").alias("tip"), decimal_year(F.col("day")).alias("num_date"))


@query("alignment_frequencies", None)
def alignment_frequencies(spark, tables):
    """Letters of part names over the first shipments of all shipped parts."""
    dates = part_dates(tables)
    rows = part_sequences(tables).withColumnRenamed("id", "tip").join(dates.select("tip"), "tip", "left_semi")
    return frequencies.alignment_frequencies(rows, dates, [1992.0 + i / 2 for i in range(14)], least=0.02, ignore="N")


@query("nested_clade_frequencies", None)
def nested_clade_frequencies(spark, tables):
    """Clades of the customer tree over the first orders of its tips."""
    nodes = heap_nodes(tables)
    first = tables("orders").groupBy((F.col("o_custkey") + 1).cast("string").alias("node")).agg(F.to_date(F.min("o_orderdate")).alias("day"))
    dates = nodes.where("is_tip").join(first, "node").select("node", decimal_year(F.col("day")).alias("num_date"))
    return frequencies.nested_clade_frequencies(nodes, dates, [1992.0 + i / 2 for i in range(14)], least_leaves=50)


@query("stream_curated_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_curated_counts(spark, tables):
    """Stateless curation in a stream that runs to its end, then counts."""
    from strandmill.streaming import streams

    schema = tables("events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(tables.folder)
    cleaned = streams.curated(stream, lambda df: df.withColumn("event_type", F.trim("event_type")))
    path = tables.fresh("stream")
    streams.run_to_files(cleaned.select("event_type"), path, f"{path}-checkpoint")
    return spark.read.schema("event_type string").parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _in_two_runs(spark, tables, rows, made):
    """``made`` of a stream of files in micro-batches, stopped after half of the files and
    taken up again from its checkpoint: what it has written in all."""
    from strandmill.streaming import streams

    source, target = tables.fresh("arriving"), tables.fresh("sent")
    schema = rows.schema
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == half).repartition(3).write.mode("append").parquet(source)
        stream = made(streams.read_stream(spark, source, schema))
        streams.run_to_files(stream, target, f"{target}-checkpoint")
    return spark.read.schema(stream.schema).parquet(target)


@query("stream_topk_group", "SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS strain FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey DESC) <= 3")
def stream_topk_group(spark, tables):
    """The dearest three orders of each priority and month, kept as state of a stream."""
    from strandmill.streaming import topk

    rows = tables("orders").select(F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("strain"))
    by = ["priority", "month"]
    sent = _in_two_runs(spark, tables, rows, lambda stream: topk.top_rows(stream, by, 3, ["price", "strain"]))
    return topk.latest_rows(sent, by).select(*by, "strain")


@query("stream_first_per_id", "SELECT c_custkey AS id, count(*) AS n FROM customer GROUP BY 1")
def stream_first_per_id(spark, tables):
    """Ids that come twice pass once, even across a restart."""
    from strandmill.streaming import streams

    rows = tables("customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    sent = _in_two_runs(spark, tables, rows, lambda stream: streams.first_per_id(stream, "id"))
    return sent.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
