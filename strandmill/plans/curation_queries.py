"""Curation of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import sequences
from strandmill.operators import clades, curate
from strandmill.plans.registry import query


@query("curate_titlecase", "SELECT p_partkey, array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(p_name, ' ')], ' ') || ' de la USA' AS name FROM part")
def curate_titlecase(spark, tables):
    df = tables("part").select("p_partkey", F.concat(F.upper("p_name"), F.lit(" DE LA USA")).alias("name"))
    return curate.titlecase(df, ["name"], articles=["de", "la"], abbreviations=["usa"])


@query("curate_normalize", "SELECT doc_id, md5(trim(text, ' \n\t')) AS digest FROM documents")
def curate_normalize(spark, tables):
    df = curate.normalize_strings(tables("documents").select("doc_id", "text"), "NFC")
    return df.select("doc_id", F.md5("text").alias("digest"))


@query("curate_authors", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '?' WHEN p_partkey % 7 = 3 THEN split_part(p_name, ' ', 1) || ' et al' WHEN p_partkey % 7 = 4 THEN split_part(p_name, ' ', 1) || 'et al et al.' ELSE split_part(p_name, ' ', 1) || ' et al.' END AS authors FROM part")
def curate_authors(spark, tables):
    first = F.split("p_name", " ")[0]
    text = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 7 == 3, F.concat(first, F.lit(" et al"))).when(F.col("p_partkey") % 7 == 4, F.concat(first, F.lit("et al"))).when(F.col("p_partkey") % 3 == 0, F.concat(first, F.lit(" et al."))).when(F.col("p_partkey") % 3 == 1, F.concat(first, F.lit(",  B.; C, D"))).otherwise(F.concat(first, F.lit(" and  Other")))
    return curate.abbreviate_authors(tables("part").select("p_partkey", text.alias("authors")))


@query("curate_genbank_location", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'x' ELSE n_name END AS country, CASE WHEN c_custkey % 4 IN (1, 2) THEN c_mktsegment ELSE '' END AS division, CASE WHEN c_custkey % 4 = 2 THEN c_name || ', b' ELSE '' END AS location FROM customer JOIN nation ON c_nationkey = n_nationkey")
def curate_genbank_location(spark, tables):
    c = tables("customer").join(F.broadcast(tables("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey") % 4
    place = F.when(key == 0, F.col("n_name")).when(key == 1, F.concat_ws(":", "n_name", "c_mktsegment")).when(key == 2, F.concat("n_name", F.lit(":"), "c_mktsegment", F.lit(", "), "c_name", F.lit(", b"))).otherwise("x:y:z")
    return curate.parse_genbank_location(c.select("c_custkey", place.alias("geo_loc_name"))).drop("geo_loc_name")


@query("curate_strain_name", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#[1-3]') THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS strain FROM part")
def curate_strain_name(spark, tables):
    df = tables("part").select("p_partkey", F.col("p_brand").alias("strain"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("b1"), F.col("p_name").alias("b2"))
    return curate.transform_strain_name(df, "Brand#[1-3]", ["b1", "b2"]).select("p_partkey", "strain")


@query("curate_rename", "SELECT p_partkey AS id, p_partkey AS key, p_name AS brand FROM part")
def curate_rename(spark, tables):
    df = tables("part").select("p_partkey", F.col("p_brand").alias("brand"), "p_name")
    return curate.rename(df, [("p_partkey", "id"), ("p_partkey", "key"), ("p_name", "brand")], force=True)


@query("curate_prettify", "SELECT c_custkey, upper(left(c_mktsegment, 1)) || substr(lower(c_mktsegment), 2) || ' Of Trade' AS shown FROM customer")
def curate_prettify(spark, tables):
    name = F.concat(F.lower("c_mktsegment"), F.lit("_of_trade"))
    return tables("customer").select("c_custkey", curate.prettify(name).alias("shown"))


@query(
    "curate_geolocation",
    "SELECT c_custkey, CASE WHEN n_name = 'FRANCE' THEN 'EUROPE' ELSE r_name END AS region, CASE WHEN n_name = 'FRANCE' THEN 'Gallia' WHEN r_name = 'ASIA' AND n_name <> 'JAPAN' THEN 'Orient' ELSE n_name END AS country, CASE WHEN n_name = 'JAPAN' AND c_mktsegment = 'BUILDING' THEN 'Edo' ELSE c_mktsegment END AS division, '' AS location FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def curate_geolocation(spark, tables):
    rows = tables("customer").join(F.broadcast(tables("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(tables("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    df = rows.select("c_custkey", F.col("r_name").alias("region"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("division"), F.lit("").alias("location"))
    rules = {("europe", "france", "*", "*"): ("EUROPE", "Gaul", "*", "*"), ("europe", "gaul", "*", "*"): ("EUROPE", "Gallia", "*", "*"), ("asia", "*", "*", "*"): ("*", "Orient", "*", "*"), ("asia", "japan", "building", "*"): ("ASIA", "JAPAN", "Edo", "*"), ("asia", "japan", "*", "*"): ("*", "*", "*", "*")}
    return curate.apply_geolocation_rules(df, curate.LocationRules(rules))


@query(
    "curate_format_dates",
    "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 6 THEN 'XXXX-XX-XX' WHEN 7 THEN 'XXXX-XX-XX' WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-XX' WHEN 2 THEN strftime(o_orderdate, '%Y') || '-XX-XX' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN 'XXXX-XX-XX' ELSE strftime(o_orderdate, '%Y') || '-01-01/' || strftime(o_orderdate, '%Y') || '-12-31' END AS date FROM orders",
)
def curate_format_dates(spark, tables):
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = (
        F.when(key == 0, F.date_format(day, "d/M/yyyy")).when(key == 1, F.date_format(day, "yyyy/MM")).when(key == 2, F.date_format(day, "yyyy"))
        .when(key == 3, F.date_format(day, "yyyy-MM-dd")).when(key == 4, "never").when(key == 6, F.date_format(day, "MM.dd")).when(key == 7, F.date_format(day, "'m'M")).otherwise(F.concat(F.lit("["), F.year(day), F.lit(" TO "), F.year(day), F.lit("]")))
    )
    df = tables("orders").select("o_orderkey", text.alias("date"))
    return curate.format_dates(df, ["date"], ["%Y", "%Y/%m", "%d/%m/%Y", "%m.%d", "m%m"])


@query("curate_fix_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') || '-XX-XX' WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-XX' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def curate_fix_dates(spark, tables):
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(key == 0, F.date_format(day, "yyyy")).when(key == 1, F.date_format(day, "yyyy-M")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return tables("orders").select("o_orderkey", curate.fix_date(text).alias("date"))


@query("parse_headers", "SELECT translate(replace(p_name, ' ', ''), '()[]:,;', '_______') || '_' || p_partkey AS strain, p_brand AS brand, '' AS missing FROM part")
def parse_headers(spark, tables):
    head = F.concat("p_name", F.lit(":"), "p_partkey", F.lit("| "), "p_brand")
    df = tables("part").select(head.alias("description"))
    return curate.parse_header(df, "description", ["strain", "brand", "missing"]).drop("description")


@query("author_suffix", "WITH w AS (SELECT p_brand AS author, p_type AS title, '' AS journal, min(p_partkey) AS seen FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seen, title) - 1 AS k, count(*) OVER (PARTITION BY author) AS c FROM w) SELECT author, title, CASE WHEN c = 1 THEN author WHEN k < 26 THEN author || ' ' || chr((65 + k)::INT) ELSE author || ' ' || chr((65 + (k - 26) // 26)::INT) || chr((65 + (k - 26) % 26)::INT) END AS label FROM r")
def author_suffix(spark, tables):
    rows = tables("part").select(F.col("p_brand").alias("author"), F.col("p_type").alias("title"), F.lit("").alias("journal"), F.col("p_partkey").alias("seen"))
    return clades.author_labels(rows).select("author", "title", "label")


@query("json_props", None)
def json_props(spark, tables):
    return tables("events").select("event_id", F.to_json(F.from_json("props", "map<string,string>")).alias("props"))


@query("defline_round_trip", "SELECT p_partkey, p_name || '|a/b(1)' AS name FROM part")
def defline_round_trip(spark, tables):
    name = F.concat("p_name", F.lit("|a/b(1)"))
    return tables("part").select("p_partkey", sequences.unescaped_defline(sequences.escaped_defline(name)).alias("name"))


@query("url_validity", "SELECT page_id, regexp_matches(url, '^[a-z]+://[^/]+') AS valid FROM pages")
def url_validity(spark, tables):
    host = F.try_parse_url("url", F.lit("HOST"))
    return tables("pages").select("page_id", (host.isNotNull() & F.try_parse_url("url", F.lit("PROTOCOL")).isNotNull()).alias("valid"))
