"""Filters, sampling, merging and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandmill.functions import dates
from strandmill.operators import frequencies, merge, predicates, sampling
from strandmill.plans import dag
from strandmill.plans.registry import query

TODAY = dt.date(2100, 1, 1)
#: A date's decimal year, and the md5 draw, in DuckDB.
DECIMAL = "(year({d}) + (dayofyear({d}) - 0.5) / dayofyear(make_date(year({d}), 12, 31)))"
DRAW = "('0x' || substr(md5('{seed}:' || {id}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def orders_metadata(tables):
    """Orders as all-text metadata: strain, date, status, priority, price."""
    return tables("orders").select(
        F.col("o_orderkey").cast("string").alias("strain"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("custkey"),
    )


@query("filter_exclude_where", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) <> 'building' AND NOT (lower(c_name) <> 'x' AND lower(c_mktsegment) = 'machinery')")
def filter_exclude_where(spark, tables):
    df = tables("customer")
    rules = [predicates.exclude_where(df, "c_mktsegment=BUILDING"), predicates.exclude_where(df, "c_mktsegment = Machinery"), predicates.exclude_where(df, "nothing=here")]
    return predicates.kept(predicates.attributed(df, rules)).select("c_custkey", "c_mktsegment")


@query("filter_query_expr", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((l_quantity > 10 AND l_quantity <= 30) OR l_returnflag IN ('R')) AND NOT (l_linestatus = 'O') AND starts_with(l_returnflag, 'R')")
def filter_query_expr(spark, tables):
    df = tables("lineitem")
    text = "((10 < l_quantity <= 30) | (l_returnflag in ['R'])) and not (`l_linestatus` == 'O') and l_returnflag.str.startswith('R')"
    return df.where(predicates.by_query(df, text).passes).select("l_orderkey", "l_linenumber")


@query(
    "filter_date_range",
    f"SELECT o_orderkey::VARCHAR AS strain, round({DECIMAL.format(d='o_orderdate::DATE')}, 9) AS num_date FROM orders WHERE {DECIMAL.format(d='o_orderdate::DATE')} BETWEEN {dates.bound('1995-03-01')!r} AND {dates.bound('1997.5')!r}",
)
def filter_date_range(spark, tables):
    df = orders_metadata(tables)
    kept = predicates.kept(predicates.attributed(df, [predicates.min_date("1995-03-01"), predicates.max_date("1997.5")]))
    return kept.select("strain", F.round(dates.numeric_range(F.col("date"), TODAY)["lo"], 9).alias("num_date"))


_MASKED = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-XX') WHEN 1 THEN strftime(o_orderdate, '%Y-XX-XX') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END"


def masked_orders(tables):
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(key == 0, F.date_format(day, "yyyy-MM-'XX'")).when(key == 1, F.date_format(day, "yyyy-'XX-XX'")).when(key == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyy-MM"))
    return tables("orders").select(F.col("o_orderkey").cast("string").alias("strain"), text.alias("date"))


@query("filter_ambiguous_dates", f"SELECT o_orderkey::VARCHAR AS strain, {_MASKED} AS date, o_orderkey % 4 <> 2 AS ambiguous_day, o_orderkey % 4 = 1 AS ambiguous_month FROM orders WHERE o_orderkey % 4 <> 1")
def filter_ambiguous_dates(spark, tables):
    df = masked_orders(tables)
    kept = predicates.kept(predicates.attributed(df, [predicates.ambiguous_date(df, by="month")]))
    return kept.select("strain", "date", dates.is_ambiguous(F.col("date"), "day").alias("ambiguous_day"), dates.is_ambiguous(F.col("date"), "month").alias("ambiguous_month"))


_LOW = "CASE o_orderkey % 4 WHEN 1 THEN date_trunc('year', o_orderdate)::DATE WHEN 2 THEN o_orderdate::DATE ELSE date_trunc('month', o_orderdate)::DATE END"
_HIGH = "CASE o_orderkey % 4 WHEN 1 THEN make_date(year(o_orderdate), 12, 31) WHEN 2 THEN o_orderdate::DATE ELSE last_day(o_orderdate) END"


@query("date_ranges", f"SELECT o_orderkey::VARCHAR AS strain, round({DECIMAL.format(d=f'({_LOW})')}, 8) AS lo, round({DECIMAL.format(d=f'({_HIGH})')}, 8) AS hi FROM orders")
def date_ranges(spark, tables):
    found = dates.numeric_range(F.col("date"), TODAY)
    return masked_orders(tables).select("strain", found.alias("r")).select("strain", F.round("r.lo", 8).alias("lo"), F.round("r.hi", 8).alias("hi"))


@query("filter_include_override", "SELECT o_orderkey::VARCHAR AS strain FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 10 = 0")
def filter_include_override(spark, tables):
    df = orders_metadata(tables)
    listed = tables("orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string"))
    df = predicates.with_membership(df, listed, "strain", "forced")
    marked = predicates.attributed(df, [predicates.exclude_where(df, "status=F")], [predicates.included_ids("forced")])
    return predicates.kept(marked).select("strain")


@query(
    "filter_attribution",
    f"""SELECT CASE WHEN lower(o_orderstatus) = 'f' THEN 'filter_by_exclude_where' WHEN {DECIMAL.format(d='o_orderdate::DATE')} < 1996.0 THEN 'filter_by_min_date'
        WHEN NOT o_totalprice > 50000 THEN 'filter_by_query' END AS filter, count(*) AS n FROM orders GROUP BY 1""",
)
def filter_attribution(spark, tables):
    df = orders_metadata(tables)
    rules = [predicates.exclude_where(df, "status=F"), predicates.min_date(1996.0), predicates.by_query(df, "price > 50000")]
    return predicates.attributed(df, rules).groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query("filter_id_lists", "SELECT c_custkey::VARCHAR AS strain FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def filter_id_lists(spark, tables):
    df = tables("customer").select(F.col("c_custkey").cast("string").alias("strain"))
    orders = tables("orders").select(F.col("o_custkey").cast("string"), "o_orderstatus")
    df = predicates.with_membership(df, orders.select("o_custkey"), "strain", "has")
    df = predicates.with_membership(df, orders.where("o_orderstatus = 'P'").select("o_custkey"), "strain", "gone")
    return predicates.kept(predicates.attributed(df, [predicates.has_sequence("has"), predicates.excluded_ids("gone")])).select("strain")


@query("subsample_topk_group", "SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey::VARCHAR AS strain FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey DESC) <= 3")
def subsample_topk_group(spark, tables):
    keyed = sampling.group_keys(orders_metadata(tables), ["priority", "month"])
    kept = sampling.top_per_group(keyed, ["group_priority", "group_month"], 3, F.col("price"), [F.col("strain").cast("long")])
    return kept.select(F.col("group_priority").alias("priority"), F.col("group_month").alias("month"), "strain")


_EVEN = """WITH o AS (SELECT o_orderkey, o_totalprice, c_nationkey, strftime(o_orderdate, '%Y') AS year FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(o_orderstatus) <> 'p'),
  forced AS (SELECT * FROM o WHERE o_orderkey % 500 = 0), pool AS (SELECT * FROM o WHERE o_orderkey % 500 <> 0),
  g AS (SELECT c_nationkey, year, count(*) AS n FROM pool GROUP BY ALL), t AS (SELECT greatest(500, count(*)) AS total FROM g),
  k AS (SELECT max(size) AS size FROM (SELECT size, sum(least(size, n)) AS taken FROM (SELECT unnest(range(1, total + 1)) AS size FROM t), g GROUP BY size), t WHERE taken <= total)
  SELECT o_orderkey::VARCHAR AS strain, c_nationkey::VARCHAR AS nation, year, false AS forced FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, year ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM pool) WHERE rn <= (SELECT size FROM k)
  UNION ALL SELECT o_orderkey::VARCHAR, c_nationkey::VARCHAR, year, true FROM forced"""


@query("subsample_even_orders", _EVEN)
def subsample_even_orders(spark, tables):
    """Flagship: orders without pending ones, spread evenly over nation and year by price,
    with some forced in."""
    df = orders_metadata(tables).join(tables("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").cast("string").alias("nation")), "custkey")
    marked = predicates.attributed(df, [predicates.exclude_where(df, "status=P")], [predicates.by_query(df, "strain.str.fullmatch('([0-9]*[05])?00|0')")])
    passed = marked.where("passed")
    forced = F.size("included") > 0
    pool = sampling.group_keys(passed.where(~forced), ["nation", "year"])
    by = ["group_nation", "group_year"]
    total = max(500, pool.groupBy(*by).count().count())
    kept = sampling.sample_even(pool, by, total, F.col("price"), [F.col("strain").cast("long")])
    chosen = sampling.group_keys(passed.where(forced), ["nation", "year"]).unionByName(kept.select(*pool.columns))
    return chosen.select("strain", F.col("group_nation").alias("nation"), F.col("group_year").alias("year"), (F.size("included") > 0).alias("forced"))


_WEIGHTED = f"""WITH d AS (SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 3.0::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM orders),
  g AS (SELECT o_orderpriority, count(*) AS n, max(w) AS weight FROM d GROUP BY 1),
  z AS (SELECT o_orderpriority, floor(weight / sum(weight) OVER () * 400 + ('0x' || substr(md5('round:' || o_orderpriority), 1, 8))::BIGINT / 4294967296.0::DOUBLE)::INT AS size FROM g)
  SELECT o_orderkey::VARCHAR AS strain, d.o_orderpriority AS priority, size FROM d JOIN z USING (o_orderpriority)
  QUALIFY row_number() OVER (PARTITION BY d.o_orderpriority ORDER BY {DRAW.format(seed='pick', id='o_orderkey')} DESC, o_orderkey DESC) <= size"""


@query("subsample_weighted", _WEIGHTED)
def subsample_weighted(spark, tables):
    keyed = sampling.group_keys(orders_metadata(tables), ["priority"])
    counts = keyed.groupBy("group_priority").agg(F.count(F.lit(1)).alias("n"))
    weights = spark.createDataFrame([("1-URGENT", 3.0), ("2-HIGH", 2.0), ("default", 0.5)], "priority string, weight double")
    rounding = F.conv(F.substring(F.md5(F.concat(F.lit("round:"), "group_priority")), 1, 8), 16, 10).cast("double") / 4294967296.0
    sizes = sampling.weighted_sizes(counts, weights, ["priority"], ["priority"], 400, rounding).select("group_priority", "size")
    rows = keyed.join(F.broadcast(sizes), "group_priority")
    kept = sampling.top_per_group(rows, ["group_priority"], F.col("size"), sampling.hashed_priority("strain", "pick"), [F.col("strain").cast("long")], most=401)
    return kept.select("strain", F.col("group_priority").alias("priority"), "size")


@query("subsample_limit", f"SELECT o_orderkey::VARCHAR AS strain FROM orders ORDER BY {DRAW.format(seed=7, id='o_orderkey')} DESC, o_orderkey DESC LIMIT 250")
def subsample_limit(spark, tables):
    return sampling.top_rows(orders_metadata(tables), 250, sampling.hashed_priority("strain", 7), [F.col("strain").cast("long")]).select("strain")


@query("group_year_month", "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL")
def group_year_month(spark, tables):
    df = tables("events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return sampling.group_keys(df, ["event_type", "month"]).groupBy("event_type", F.col("group_month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("group_iso_week", "SELECT printf('%04d-%02d', isoyear(o_orderdate), weekofyear(o_orderdate)) AS week, count(*) AS n FROM orders GROUP BY ALL")
def group_iso_week(spark, tables):
    keyed = sampling.group_keys(orders_metadata(tables), ["year", "week"])
    return keyed.groupBy(F.col("group_week").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("priority_ties", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) <= 2")
def priority_ties(spark, tables):
    kept = sampling.top_per_group(tables("lineitem"), ["l_suppkey"], 2, F.col("l_quantity"), [F.col("l_orderkey"), F.col("l_linenumber")])
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber")


@query("subsample_poisson", f"""WITH g AS (SELECT o_custkey, ('0x' || substr(md5('poisson:5|' || o_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw, (SELECT 60.0::DOUBLE / count(DISTINCT o_custkey) FROM orders) AS mean FROM orders GROUP BY 1),
  z AS (SELECT o_custkey, (draw >= exp(-mean))::INT + (draw >= exp(-mean) * (1 + mean))::INT + (draw >= exp(-mean) * (1 + mean + mean * mean / 2))::INT + (draw >= exp(-mean) * (1 + mean + mean * mean / 2 + pow(mean, 3) / 6))::INT AS size FROM g)
  SELECT o_orderkey::VARCHAR AS strain, o_custkey::VARCHAR AS group_own FROM orders JOIN z USING (o_custkey) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {DRAW.format(seed=3, id="o_orderkey")} DESC, o_orderkey::VARCHAR DESC) <= size""")
def subsample_poisson(spark, tables):
    return groups_poisson_total(spark, tables)


@query("groups_poisson_total", None)
def groups_poisson_total(spark, tables):
    keyed = sampling.group_keys(orders_metadata(tables).withColumn("own", F.col("custkey").cast("string")), ["own"])
    return sampling.sample_even(keyed, ["group_own"], 60, sampling.hashed_priority("strain", 3), [F.col("strain")], seed=5).select("strain", "group_own")


@query("empty_and_repeated_ids", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def empty_and_repeated_ids(spark, tables):
    return merge.duplicate_ids(tables("conversations"), "conv_id")


_X = "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, c_name AS name FROM customer WHERE c_custkey % 2 = 0"
_Y = "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'y' || c_nationkey END AS segment, c_nationkey::VARCHAR AS nation FROM customer WHERE c_custkey % 3 <> 1"
_Z = "SELECT s_suppkey::VARCHAR AS id, s_name AS name, '' AS nation FROM supplier"


def _merge_inputs(tables):
    c, s = tables("customer"), tables("supplier")
    x = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("name"))
    y = c.where("c_custkey % 3 <> 1").select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("y"), "c_nationkey")).alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    z = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("nation"))
    return {"X": (x, "id"), "Y": (y, "key"), "Z": (z, "id")}


_MERGE = f"""WITH x AS ({_X}), y AS ({_Y}), z AS ({_Z}) SELECT coalesce(x.id, y.id, z.id) AS id,
  coalesce(nullif(y.segment, ''), nullif(x.segment, ''), '') AS segment, coalesce(nullif(z.name, ''), nullif(x.name, ''), '') AS name, coalesce(nullif(z.nation, ''), nullif(y.nation, ''), '') AS nation{{extra}}
  FROM x FULL JOIN y ON x.id = y.id FULL JOIN z ON z.id = coalesce(x.id, y.id)"""


@query("merge_full_outer", _MERGE.format(extra=""))
def merge_full_outer(spark, tables):
    return merge.merge_metadata(_merge_inputs(tables))


@query("merge_source_columns", _MERGE.format(extra=", (x.id IS NOT NULL)::INT AS in_X, (y.id IS NOT NULL)::INT AS in_Y, (z.id IS NOT NULL)::INT AS in_Z"))
def merge_source_columns(spark, tables):
    return merge.merge_metadata(_merge_inputs(tables), source_columns="in_{NAME}")


@query("merge_sequences_last_wins", "WITH r AS (SELECT doc_id::VARCHAR AS id, text, 0 AS o FROM documents UNION ALL SELECT item_id::VARCHAR, text, 1 FROM benchmark) SELECT id, md5(arg_max(text, o)) AS digest FROM r GROUP BY id")
def merge_sequences_last_wins(spark, tables):
    docs = tables("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("sequence"))
    items = tables("benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("sequence"))
    return merge.merge_sequences([docs, items]).select("id", F.md5("sequence").alias("digest"))


@query(
    "join_metadata_sequences",
    "SELECT 'joined' AS side, doc_id::VARCHAR AS id, md5(upper(replace(text, 'ß', 'SS'))) AS digest FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'no sequence', doc_id::VARCHAR, NULL FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'no sequence', 'item ' || item_id, NULL FROM benchmark UNION ALL SELECT 'no metadata', doc_id::VARCHAR, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def join_metadata_sequences(spark, tables):
    # Items of the benchmark have no document, so that both reports have rows.
    items = tables("benchmark").select(F.concat(F.lit("item "), "item_id").alias("strain"))
    meta = tables("labels").select(F.col("doc_id").cast("string").alias("strain")).unionByName(items)
    docs = tables("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("sequence"))
    joined, lone, rest = merge.metadata_with_sequences(meta, docs, "strain")
    none = F.lit(None).cast("string").alias("digest")
    sides = [(joined, "joined", F.md5("sequence").alias("digest")), (lone, "no sequence", none), (rest, "no metadata", none)]
    one, two, three = (df.select(F.lit(side).alias("side"), F.col("strain").alias("id"), d) for df, side, d in sides)
    return one.unionByName(two).unionByName(three)


@query("record_annotations", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' || p_partkey ELSE p_brand END AS brand, CASE WHEN p_partkey % 7 = 0 THEN 'type' ELSE p_type END AS type FROM part")
def record_annotations(spark, tables):
    part = tables("part")
    df = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    key = F.col("p_partkey").cast("string").alias("id")
    notes = part.where("p_partkey % 5 = 0").select(key, F.lit("brand").alias("field"), F.lit("old").alias("value"), F.lit(0).alias("line"))
    notes = notes.unionByName(part.where("p_partkey % 5 = 0").select(key, F.lit("brand").alias("field"), F.concat(F.lit("new"), "p_partkey").alias("value"), F.lit(1).alias("line")))
    notes = notes.unionByName(part.where("p_partkey % 7 = 0").select(key, F.lit("type").alias("field"), F.lit("type").alias("value"), F.lit(2).alias("line")))
    notes = notes.unionByName(part.select(key, F.lit("absent").alias("field"), F.lit("x").alias("value"), F.lit(3).alias("line")))
    return merge.annotate(df, notes, "id")


@query("cross_weights", "WITH g AS (SELECT r_name, n_name, n_regionkey + 1 AS w FROM region JOIN nation ON r_regionkey = n_regionkey), s AS (SELECT r_name, n_name, w::DOUBLE / count(*) OVER (PARTITION BY r_name) AS weight FROM g) SELECT r_name, n_name, round(weight, 9) AS weight, floor(weight / sum(weight) OVER () * 100 + 0.5)::INT AS size FROM s")
def cross_weights(spark, tables):
    region, nation = tables("region"), tables("nation")
    counts = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("group_r"), F.col("n_name").alias("group_n"), F.lit(1).alias("n"))
    weights = region.select(F.col("r_name").alias("r"), (F.col("r_regionkey") + 1).cast("double").alias("weight"))
    sizes = sampling.weighted_sizes(counts, weights, ["r"], ["r", "n"], 100, F.lit(0.5))
    return sizes.select(F.col("group_r").alias("r_name"), F.col("group_n").alias("n_name"), F.round("weight", 9).alias("weight"), "size")


@query(
    "node_merge_deep",
    "WITH e AS (SELECT c_custkey::VARCHAR AS node, 'a.segment' AS path, c_mktsegment AS value, 0 AS ord FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'a.segment', upper(c_name), 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'b', c_nationkey::VARCHAR, 2 FROM customer WHERE c_custkey % 3 = 0) SELECT node, path, arg_max(value, ord) AS value FROM e GROUP BY ALL",
)
def node_merge_deep(spark, tables):
    c = tables("customer")
    node = F.col("c_custkey").cast("string").alias("node")
    one = c.select(node, F.lit("a.segment").alias("path"), F.col("c_mktsegment").alias("value"), F.lit(0).alias("ord"))
    two = c.where("c_custkey % 2 = 0").select(node, F.lit("a.segment").alias("path"), F.upper("c_name").alias("value"), F.lit(1).alias("ord"))
    three = c.where("c_custkey % 3 = 0").select(node, F.lit("b").alias("path"), F.col("c_nationkey").cast("string").alias("value"), F.lit(2).alias("ord"))
    return merge.deep_merge(one.unionByName(two).unionByName(three))


@query(
    "dag_subsample",
    f"""WITH a AS (SELECT * FROM orders WHERE lower(o_orderstatus) = 'o'), b AS (SELECT * FROM a WHERE o_totalprice > 100000 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {DRAW.format(seed='b', id='o_orderkey')} DESC, o_orderkey::VARCHAR DESC) <= 5),
        c AS (SELECT * FROM orders WHERE lower(o_orderstatus) = 'p') SELECT o_orderkey::VARCHAR AS strain FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM b UNION ALL SELECT o_orderkey FROM c)""",
)
def dag_subsample(spark, tables):
    config = {
        "samples": {
            "b": {"context_sample": "a", "query": "price > 100000", "group_by": ["priority"], "group_size": 5},
            "a": {"exclude_where": ["status!=O"], "drop_sample": True},
            "c": {"exclude_where": ["status!=P"]},
        }
    }
    df = orders_metadata(tables)
    samples = dag.parse(config)
    return dag.united(samples, dag.run(samples, df, "strain"), df, "strain").select("strain")


@query("set_operations", "SELECT 'both' AS side, c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'left', c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, tables):
    rich = tables("customer").where("c_acctbal > 0").select("c_custkey")
    both, left = merge.common_and_missing(rich, tables("orders").select("o_custkey"))
    return both.select(F.lit("both").alias("side"), "c_custkey").unionByName(left.select(F.lit("left").alias("side"), "c_custkey"))


@query("float_to_date", "SELECT o_orderkey, o_orderdate::DATE AS day, round(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0::DOUBLE + (day(o_orderdate) - 1) / 365.25::DOUBLE, 8) AS coarse FROM orders")
def float_to_date(spark, tables):
    day = F.to_date("o_orderdate")
    return tables("orders").select("o_orderkey", dates.date_of_decimal_year(dates.decimal_year(day)).alias("day"), F.round(dates.coarse_decimal_year(day), 8).alias("coarse"))


@query("filter_log_counts", "SELECT filter, kwargs, count(*) AS n FROM (SELECT CASE WHEN lower(o_orderstatus) = 'f' THEN 'filter_by_exclude_where' ELSE 'filter_by_query' END AS filter, CASE WHEN lower(o_orderstatus) = 'f' THEN '{\"exclude_where\": \"status=F\"}' ELSE '{\"query\": \"price > 50000\"}' END AS kwargs FROM orders WHERE lower(o_orderstatus) = 'f' OR NOT o_totalprice > 50000 UNION ALL SELECT 'force_include_where', '{}' FROM orders WHERE lower(o_orderpriority) = '1-urgent') GROUP BY ALL")
def filter_log_counts(spark, tables):
    df = orders_metadata(tables)
    marked = predicates.attributed(df, [predicates.exclude_where(df, "status=F"), predicates.by_query(df, "price > 50000")], [predicates.include_where(df, "priority=1-URGENT")])
    return predicates.filter_log(marked, "strain").groupBy("filter", "kwargs").agg(F.count(F.lit(1)).alias("n"))


@query("first_last_observation", "SELECT user_id, event_id, round(value - lag(value) OVER w, 6) AS step, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total, min(event_id) OVER (PARTITION BY user_id) AS first_seen, max(event_id) OVER (PARTITION BY user_id) AS last_seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def first_last_observation(spark, tables):
    found = frequencies.observation_cutoffs(tables("events"), "user_id", "event_id", "value")
    return found.select("user_id", "event_id", F.round("step", 6).alias("step"), F.round("total", 4).alias("total"), "first_seen", "last_seen")
