"""Variant calls, linear sequence kernels and alignment membership at their edges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandmill.functions import sequences
from strandmill.operators import alignment, variants

CALLS = "chrom string, sample string, pos int, alt string"
FEATURES = "chrom string, feature string, start long, end long, strand int"


def brute(calls, features, reference):
    """Amino acids of every sample's whole features, compared letter by letter."""
    code = sequences.codon_table()
    other = dict(zip("ACGTN", "TGCAN", strict=True))
    out = set()
    for sample in {c[1] for c in calls}:
        for chrom, name in {f[:2] for f in features}:
            old = list(reference[chrom])
            new = list(old)
            for c in sorted((c for c in calls if c[1] == sample and c[0] == chrom), key=lambda c: c[3]):
                if 0 < c[2] <= len(new):
                    new[c[2] - 1] = c[3]
            parts = sorted(f[2:] for f in features if f[:2] == (chrom, name))
            read = []
            for letters in (old, new):
                text = "".join("".join(letters[s:e]) for s, e, _ in parts)
                read.append("".join(other[x] for x in reversed(text)) if parts[0][2] < 0 else text)
            for i in range(len(read[0]) // 3):
                a, b = (code.get(r[3 * i : 3 * i + 3], "X") for r in read)
                if a != b:
                    out.add((chrom, sample, name, i + 1, a, b))
    return out


def test_translated_calls_against_whole_genomes(spark, monkeypatch):
    rng = random.Random(4)
    reference = {c: "".join(rng.choice("ACGT") for _ in range(400)) for c in "xy"}
    features = [("x", "f", 10, 100, 1), ("x", "r", 60, 161, -1), ("x", "j", 5, 21, 1), ("x", "j", 190, 230, 1), ("y", "q", 0, 50, -1), ("y", "q", 61, 75, -1), ("y", "q", 300, 333, -1), ("y", "end", 390, 400, 1)]
    calls = [(rng.choice("xy"), f"s{rng.randrange(12)}", rng.randrange(1, 401), rng.choice("ACGTN")) for _ in range(300)]
    calls += [("x", "s0", 14, "A"), ("x", "s0", 15, "C"), ("x", "s0", 16, "G"), ("x", "s0", 0, "A"), ("z", "s0", 3, "A"), ("x", "s1", 900, "A")]
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(features, FEATURES), spark.createDataFrame(list(reference.items()), "chrom string, sequence string")
    want = brute(calls, features, reference)
    for bucket in (7, 1024):
        monkeypatch.setattr(variants, "BUCKET", bucket)
        found = variants.translated_calls(*frames)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    quiet = frames[1].unionByName(spark.createDataFrame([("x", "none", 350, 351, 1)], FEATURES))
    assert [r["feature"] for r in variants.unvaried_features(quiet, found).collect()] == ["none"]
    assert variants.translated_calls(frames[0].limit(0), *frames[1:]).count() == 0 and variants.translated_calls(frames[0], frames[1].limit(0), frames[2]).count() == 0


@pytest.mark.parametrize("make", [lambda c, n: sequences.translated(c), lambda c, n: sequences.masked(c, sites=list(range(0, n, 10))), lambda c, n: sequences.applied(c, F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit("T").alias("alt")) for i in range(0, 300, 10)]))])
def test_kernels_take_time_by_length(spark, make):
    def seconds(n):
        rows = spark.range(40).select(F.repeat(F.lit("ACGTAC"), n // 6).alias("s"))
        best = 9e9
        for _ in range(3):
            begin = time.time()
            rows.select(F.sum(F.length(make(F.col("s"), n)))).collect()
            best = min(best, time.time() - begin)
        return best

    assert seconds(240_000) < 8 * seconds(60_000) + 1


def test_kernels_of_odd_letters(spark):
    row = spark.createDataFrame([("aÄ€N-",), (None,), ("",)], "s string")
    assert [r[0] for r in row.select(sequences.masked(F.col("s"), sites=[1, 99, 2, 2])).collect()] == ["aNNN-", None, ""]
    changes = F.array(F.struct(F.lit(2).alias("pos"), F.lit("T").alias("alt")), F.struct(F.lit(2).alias("pos"), F.lit("G").alias("alt")), F.struct(F.lit(50).alias("pos"), F.lit("C").alias("alt")), F.struct(F.lit(None).cast("int").alias("pos"), F.lit("C").alias("alt")))
    assert [r[0] for r in row.select(sequences.applied(F.col("s"), changes)).collect()] == ["aG€N-C", None, "TGC"]
    assert [r[0] for r in row.where("s is null or s = ''").select(sequences.translated(F.col("s"))).collect()] == [None, ""]
    counts = sequences.nucleotide_index(row.withColumn("id", F.lit(1)), sequence="s").orderBy("length").collect()
    assert counts[2]["length"] == 5 and (counts[2]["A"], counts[2]["N"], counts[2]["-"], counts[2]["invalid_nucleotides"]) == (1, 1, 1, 2)


def test_names_with_two_sequences_fail(spark):
    rows = spark.createDataFrame([("a", "AC"), ("a", "AC"), ("b", "A"), (None, "A"), (None, "A"), ("c", None)], "id string, sequence string")
    assert alignment.collapsed(rows).count() == 4
    assert {r["id"] for r in alignment.unaligned(rows, rows.where("id = 'a'")).collect()} == {"b", None, "c"}
    with pytest.raises(Exception, match="different sequences: a"):
        alignment.collapsed(rows.unionByName(spark.createDataFrame([("a", "ACC")], rows.schema))).collect()
    assert [tuple(r) for r in alignment.repeated_names(rows.where("id is not null"), rows.where("id = 'b'")).orderBy("id").collect()] == [("a", 2), ("b", 2)]


def test_calls_of_one_chromosome_meet_features_in_many_tasks(spark, monkeypatch):
    """Calls near each other share chromosome and bucket, which is one task without samples."""
    broadcast, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    kept = {name: spark.conf.get(name) for name in (broadcast, adaptive)}
    tasks = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(alt):
        from pyspark import TaskContext

        tasks.add(1 << (16 * TaskContext.get().partitionId()))
        return alt

    monkeypatch.setattr(variants, "_letter", lambda codon, real=variants._letter: real(passed(codon)))
    try:
        for name, value in ((broadcast, "-1"), (adaptive, "false")):
            spark.conf.set(name, value)
        calls = spark.range(400).select(F.lit("c").alias("chrom"), F.col("id").cast("string").alias("sample"), F.lit(2).alias("pos"), F.lit("C").alias("alt"))
        features = spark.createDataFrame([("c", "f", 0, 6, 1)], FEATURES)
        reference = spark.createDataFrame([("c", "AAAAAA")], "chrom string, sequence string")
        found = variants.translated_calls(calls, features, reference).collect()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert {tuple(r)[2:] for r in found} == {("f", 1, "K", "T")} and len(found) == 400
    assert sum((tasks.value >> (16 * i)) & 0xFFFF > 0 for i in range(4)) > 1
