"""Packed distances, gap runs, file order, sequence files and streams against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import distance, proximity
from strandmill.sources import readers, writers
from strandmill.streaming import streams, topk


def plain_distance(a, b, missing):
    known = lambda s: [i for i, c in enumerate(s.upper()) if c in "ACGT"]
    letter = lambda c: c.upper() if c.upper() in "ACGT" else "N"
    spans = [(k[0], k[-1]) if (k := known(s)) else (1, 0) for s in (a, b)]
    total = 0
    for i, (x, y) in enumerate(zip(map(letter, a), map(letter, b), strict=True)):
        inside = all(low <= i <= high for low, high in spans)
        total += x != y and (missing == "none" or (missing == "all" and "N" not in (x, y)) or (missing == "flanking" and inside))
    return total


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_packed_distances(spark, n, monkeypatch):
    rng = random.Random(n)
    text = lambda: "".join(rng.choice("ACGTacgtN-RÄ") for _ in range(n))
    rows = [(f"s{i:02d}", text()) for i in range(20)] + [("t0", "N" * n), ("t1", "A" * n), ("t2", "T" * n)]
    df = spark.createDataFrame(rows, "id string, sequence string")
    focal = df.where("id < 's07' or id = 't0'")
    for block, unrolled in ((3, 12), (4096, 0)):
        monkeypatch.setattr(proximity, "BLOCK_ROWS", block)
        monkeypatch.setattr(proximity, "UNROLLED", unrolled)
        for missing in ("none", "all", "flanking"):
            found = proximity.neighbours(focal, df, 4, missing=missing).collect()
            for name in {r["focal"] for r in found}:
                own = dict(rows)[name]
                others = [(plain_distance(own, s, missing), sum(c.upper() not in "ACGT" for c in s), i) for i, s in rows if i >= "s07" and i != "t0"]
                got = sorted((r["distance"], r["unknown"], r["id"]) for r in found if r["focal"] == name)
                assert got == sorted(others)[:4]
            assert len(found) == 32
    near = proximity.neighbours(focal, df, 4, max_distance=n // 2).collect()
    assert all(r["distance"] <= n // 2 for r in near)
    assert proximity.neighbours(focal.limit(0), df, 4).count() == 0 and proximity.neighbours(focal, df.limit(0), 4).count() == 0


def test_copies_meet_once(spark, monkeypatch):
    """Distances are computed between different sequences, not between all their copies."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTN") for _ in range(70)) for _ in range(5)]
    rows = [(f"s{i:03d}", texts[rng.randrange(5)].lower() if i % 2 else texts[rng.randrange(5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, sequence string")
    compared, real = spark.sparkContext.accumulator(0), proximity.differences

    @F.udf("long")
    def counted(n):
        compared.add(1)
        return n

    monkeypatch.setattr(proximity, "differences", lambda *given: counted(real(*given)))
    found = proximity.neighbours(df.where("id < 's100'"), df, 3).collect()
    assert compared.value <= 5 * 5 * 3
    for name, text in rows[:100]:
        others = sorted((plain_distance(text, s, "all"), s.upper().count("N"), i) for i, s in rows[100:])
        assert sorted((r["distance"], r["unknown"], r["id"]) for r in found if r["focal"] == name) == others[:3]


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([("a", "ACG"), ("b", "AC")], "id string, sequence string")
    with pytest.raises(Exception, match="differ in length"):
        proximity.neighbours(df.where("id = 'a'"), df, 1).collect()
    with pytest.raises(ValueError, match="no rule"):
        proximity.neighbours(df.where("id = 'a'"), df, 1, missing="some")


def test_dated_pairs_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_TIPS", 16)
    tips = spark.range(400).select(F.col("id").alias("node"), (2000 + F.col("id") / 100).alias("num_date"))
    found = distance.dated_pairs(tips, 2002.0, 2001.9).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["first"], r["second"]) for r in found) == [(a, b) for a in range(190, 200) for b in range(200, 400)]
    assert len({r["task"] for r in found}) == 4


def shuffled_rows(spark, after=-1):
    """Rows that stages after a stage's number have shuffled, and the last stage's number."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = context.statusStore().stageList(none, False, False, quantiles, none)
    found = {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}
    return sum(n for stage, n in found.items() if stage > after), max(found, default=-1)


def test_dated_pairs_shuffle_each_tip_once(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_TIPS", 16)
    # A node without a name is a tip like others.
    tips = spark.range(800).select(F.expr("nullif(id, 7)").alias("node"), (2000 + F.col("id") / 100).alias("num_date")).cache()
    tips.count()
    _, last = shuffled_rows(spark)
    found = distance.dated_pairs(tips, 2004.0, 2000.0).collect()
    rows, _ = shuffled_rows(spark, last)
    tips.unpersist()
    assert len(found) == len(set(found)) == 400 * 400
    assert {r["first"] for r in found} == {None, *range(400)} - {7} and {r["second"] for r in found} == set(range(400, 800))
    # Before, later tips were repeated for each of 25 blocks; the rest are rows of a count.
    assert 800 <= rows <= 800 + 8


def walked(a, b, gene, sites, ignored):
    """A pair's distance letter by letter."""
    total, run = 0.0, []
    for site, (x, y) in enumerate(zip(a, b, strict=False)):
        entry = sites.get(gene, {}).get(site, 1.5)
        weight = entry.get((x, y), 1.5) if isinstance(entry, dict) else entry
        if x == y or x in ignored or y in ignored:
            total, run = total + (max(run) if run else 0), []
        elif "-" in (x, y):
            run.append(weight)
        else:
            total, run = total + (max(run) if run else 0) + weight, []
    return total + (max(run) if run else 0)


def test_weighted_distances_with_runs_of_gaps(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("AC---N") for _ in range(rng.randrange(0, 30)))
    pairs = [(f"p{i}", f"q{i}", g, text(), text()) for i in range(60) for g in "gh"] + [("n", "n", "g", None, "A")]
    sites = {"g": {i: float(i % 5) for i in range(0, 30, 2)} | {3: {("A", "C"): 9.0, ("-", "A"): 4.0}}, "h": {1: {("C", "A"): 0.5}}}
    df = spark.createDataFrame(pairs, "first string, second string, gene string, a string, b string")
    for ignored in ("", "N"):
        found = {r["first"]: r["distance"] for r in distance.pair_distances(df, distance.DistanceMap(1.5, sites, ignored)).collect()}
        want = {}
        for first, _, gene, a, b in pairs:
            want[first] = want.get(first, 0.0) + (walked(a, b, gene, sites, ignored) if a is not None else 0.0)
        assert found == {k: pytest.approx(v) for k, v in want.items()}


def test_sites_of_equal_pairs_are_compared_once(spark, monkeypatch):
    compared, real = spark.sparkContext.accumulator(0), distance.differing_sites

    @F.udf("string")
    def counted(a):
        compared.add(1)
        return a

    monkeypatch.setattr(distance, "differing_sites", lambda pairs, ignored: real(pairs.withColumn("a", counted("a")), ignored))
    kinds = [("AC-G", "ACTG", 1.5), ("ACGT", "AAAA", 4.5), ("A", None, 0.0), (None, "A", 0.0), ("", "", 0.0)]
    rows = [(str(i), f"x{i}", "g", *kinds[i % 5][:2]) for i in range(300)]
    df = spark.createDataFrame(rows, "first string, second string, gene string, a string, b string")
    found = {int(r["first"]): r["distance"] for r in distance.pair_distances(df, distance.DistanceMap(1.5)).collect()}
    assert found == {i: kinds[i % 5][2] for i in range(300)}
    # Expressions may be evaluated several times for a row, but not for every pair.
    assert compared.value <= 50


def test_lines_keep_their_numbers_over_partitions(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{part}.csv").write_text("k\n" + "".join(f"{part * 1000 + i}\n" for i in range(1000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        lines = spark.read.csv(path, header=True)
        assert lines.rdd.getNumPartitions() > 6
        found = readers.numbered(lines).where("k % 7 = 0")
        assert {(int(r["k"]), r["row"]) for r in found.collect()} == {(i, i) for i in range(0, 3000, 7)}
        writers.write_in_order(found.repartition(5), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    text = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().split() if line != "k"]
    assert text == [str(i) for i in range(0, 3000, 7)]
    (tmp_path / "none.csv").write_text("k\n")
    assert readers.numbered(spark.read.csv(str(tmp_path / "none.csv"), header=True, schema="k string")).count() == 0


def test_one_sequence_file_over_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    records = [(f"s{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    fasta, genbank = tmp_path / "x.fasta", tmp_path / "x.gb"
    fasta.write_text("".join(f">{n} about > {n}\n{s[:50]}\n{s[50:]}\n" for n, s in records))
    genbank.write_text("".join(f"LOCUS       {n} 5 bp\nDEFINITION  all\n            about it\nACCESSION   {n} other\n" + (f"VERSION     {n}.2\n" if n != "s3" else "") + f"ORIGIN      \n        1 {s[:10].lower()} {s[10:].lower()}\n//\n" for n, s in records))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        one = readers.read_sequences(spark, str(fasta))
        assert one.rdd.getNumPartitions() > 3
        assert sorted((r["id"], r["sequence"]) for r in one.collect()) == sorted(records)
        two = readers.read_sequences(spark, str(genbank), kind="genbank", repeats="error").collect()
        assert {(r["id"], r["sequence"]) for r in two} == {(n if n == "s3" else f"{n}.2", s) for n, s in records} and {r["description"] for r in two} == {"all about it"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    with pytest.raises(Exception, match="sequence id is repeated"):
        readers.read_sequences(spark, str(fasta), str(fasta), repeats="error").collect()
    assert readers.read_sequences(spark, str(fasta), str(fasta), repeats="same").count() == 60


def test_top_rows_close_their_groups(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("a", 1.0, at(0)), ("a", 3.0, at(1)), ("b", None, at(1))], [("a", 2.0, at(2)), ("a", 2.0, at(2)), ("b", float("nan"), at(3)), ("b", 5.0, at(3))], [("c", 1.0, at(50))], [("c", 0.5, at(51))]]
    sent, source = str(tmp_path / "out"), str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, "k string, v double, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, "k string, v double, at timestamp").withWatermark("at", "1 minute")
        streams.run_to_files(topk.top_rows(stream, ["k"], 2, ["v"], "at", close_after=60_000), sent, str(tmp_path / "check"))
    rows = spark.read.parquet(sent)
    last = {}
    for r in topk.latest_rows(rows, ["k"]).collect():
        last.setdefault(r["k"], []).append(r["v"])
    assert sorted(last["a"]) == [2.0, 3.0] and sorted(last["c"]) == [0.5, 1.0]
    assert str(sorted(last["b"], key=str)) == "[5.0, nan]"
    assert {r["k"] for r in rows.where("final").collect()} == {"a", "b"}
