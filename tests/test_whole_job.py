"""Operators count every row, whatever the size of a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import distance, frequencies, sampling
from strandmill.plans import catalog


def test_diffusion_counts_every_observation(spark):
    pivots = [2023.0, 2023.5, 2024.0, 2024.5, 2025.0]
    width = 2.0 / 200
    counts = [(k, 2000 if 92 <= k < 109 else 40) for k in range(200)]
    cells = spark.createDataFrame(counts, "cell int, n int").select("cell", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    seen = (F.col("i") % 10 < F.when(F.col("cell").between(92, 108), 7).otherwise(3)).cast("int")
    rows = cells.select(F.lit("g").alias("group"), (pivots[0] + (F.col("cell") + 0.5) * width).alias("num_date"), seen.alias("seen"))
    found = [r["frequency"] for r in frequencies.diffusion_frequencies(rows, pivots).orderBy("pivot").collect()]
    pdf = rows.toPandas()
    want = frequencies.diffusion_fit(pdf["num_date"].to_numpy(), pdf["seen"].to_numpy(), np.array(pivots))
    assert found == pytest.approx(want.tolist(), abs=1e-6)


def test_even_sampling_of_many_groups(spark):
    rows = spark.range(1_100_000).select("id", (F.col("id") % 1_000_001).alias("g"))
    kept = sampling.sample_even(rows, ["g"], 1_050_000, F.lit(0.5), [F.col("id")]).groupBy("g").count().groupBy("count").count().collect()
    assert list(map(tuple, kept)) == [(1, 1_000_001)]


def test_tips_of_site_frequencies_stay_off_the_driver(spark):
    rows = spark.range(40).select(F.col("id").alias("tip"), F.lit(2000.0).alias("pivot"), F.lit(0.025).alias("frequency"))
    letters = spark.range(40).select(F.col("id").alias("tip"), F.lit(3).alias("pos"), F.when(F.col("id") < 10, "A").otherwise("C").alias("base"))
    df = frequencies.site_frequencies(rows, letters)
    assert {(r["base"], round(r["frequency"], 6)) for r in df.collect()} == {("A", 0.25), ("C", 0.75)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [tip#" in plan and "BroadcastHashJoin [tip#" not in plan


def test_large_files_are_written_by_all_tasks(spark, tmp_path):
    from strandmill.plans import catalog

    rows = spark.range(300).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit("A").alias("l_returnflag"), F.lit(2.0).alias("l_quantity"), F.lit("F").alias("l_linestatus"))
    rows.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    events = spark.range(300).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), (F.col("id") / 4).alias("value"))
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    kept = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "128MB")
        for name in ("file_titers", "file_measurements"):
            found = catalog.QUERIES[name](spark, str(tmp_path))
            assert found.distinct().count() == found.count() == 300
            assert len(found.inputFiles()) == 3
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", kept)


def test_texts_reach_python_in_bounded_batches(spark, tmp_path):
    from strandmill import session
    from strandmill.plans import catalog

    spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 3000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.conf.getAll.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert catalog.QUERIES["curate_normalize"](spark, str(tmp_path)).count() == 3000

        @F.pandas_udf("long")
        def held(values):
            return values.str.len() * 0 + int(values.str.len().sum())

        most = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.max(held("text"))).first()[0]
        assert most <= 2 * session.BATCH_BYTES
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        if kept is not None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", kept)


def test_later_orders_meet_all_earlier_ones(spark):
    folder = "/root/testdata/sf0.001"
    later = spark.read.parquet(f"{folder}/orders.parquet").groupBy(F.col("o_orderdate") >= F.lit("1998-07-29").cast("date")).count()
    sizes = {bool(r[0]): r["count"] for r in later.collect()}
    found = catalog.QUERIES["distance_pairs_window"](spark, folder)
    counts = found.agg(F.count("*"), F.countDistinct("first"), F.countDistinct("second")).first()
    assert tuple(counts) == (sizes[False] * sizes[True], sizes[False], sizes[True])


def test_dated_pairs_without_an_earliest_date(spark):
    tips = spark.createDataFrame([("a", 1900.0), ("b", 1999.9), ("c", 2000.0), ("d", 2001.0), ("e", None)], "node string, num_date double")
    pairs = lambda *dates: sorted(map(tuple, distance.dated_pairs(tips, *dates).collect()))
    assert pairs(2000.0) == [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]
    assert pairs(2000.0, 1999.0) == [("b", "c"), ("b", "d")]
    assert pairs(1800.0) == pairs(2002.0) == []
