"""Golden values of single functions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import dates, formats, sequences
from strandmill.operators import clades, curate, distance, export, merge, predicates, proximity, sampling, titers, tree
from strandmill.plans import dag
from strandmill.sources import readers, trees, writers

TODAY = dt.date(2030, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("total, counts, size", [(3, [2, 2], 1), (3, [2, 1], 3), (9, [5, 5], 4), (9, [5, 4], 9), (9, [5, 3], 9)])
def test_even_size(total, counts, size):
    assert sampling.even_size(total, counts) == size


def test_bounds():
    today = dt.date(2000, 2, 20)
    assert dates.bound("2020-06-04") == pytest.approx(2020.42486, abs=1e-5)
    assert dates.bound("2020") == 2020.0
    for text, value in {"1W": 2000.119, "1M": 2000.053, "1Y1M1W": 1999.034}.items():
        assert dates.bound(text, today) == pytest.approx(value, abs=1e-3)


@pytest.mark.parametrize(
    "text, low, high",
    [("2000-01-XX", 2000.001, 2000.083), ("2000-01", 2000.001, 2000.083), ("2000-1", 2000.001, 2000.083), ("2000-XX-XX", 2000.001, 2000.999), ("2000-13", 2000.917, 2000.999), ("2000-00", 2000.001, 2000.083)],
)
def test_ranges(spark, text, low, high):
    found = one(spark, dates.numeric_range(F.lit(text), TODAY))
    assert (found["lo"], found["hi"]) == (pytest.approx(low, abs=1e-3), pytest.approx(high, abs=1e-3))


def test_dates_without_meaning(spark):
    for text in ("XXXX-XX-XX", "", "never", "2000-13-01", "2000-XX-01", "2001-01-01/2000-01-01"):
        assert one(spark, dates.numeric_range(F.lit(text), TODAY)) is None


def test_year_limits(spark):
    found = one(spark, dates.date_range(F.lit("20XX-XX-XX"), dt.date(2020, 5, 5), 2000, 2010))
    assert (found["lo"], found["hi"]) == (dt.date(2000, 1, 1), dt.date(2010, 12, 31))
    found = one(spark, dates.date_range(F.lit("2020-12-XX"), dt.date(2020, 5, 5)))
    assert found["lo"] == found["hi"] == dt.date(2020, 5, 5)


def test_min_date_forms(spark):
    df = spark.createDataFrame([("2020",), ("2020-XX-XX",), ("2020.0",)], "date string")
    rule = predicates.min_date("2020-02-01")
    assert [r[0] for r in predicates.kept(predicates.attributed(df, [rule])).select("date").collect()] == ["2020", "2020-XX-XX"]


def test_iso_week_and_calendar(spark):
    assert one(spark, dates.iso_week(F.lit(dt.date(2021, 1, 2)))) == "2020-53"
    assert one(spark, dates.coarse_decimal_year(F.lit(dt.date(2010, 10, 1)))) == 2010.75


def test_index(spark):
    df = spark.createDataFrame([("a", "ACTGN-?XWN"), ("b", ""), ("c", None)], "id string, sequence string")
    rows = {r["id"]: r.asDict() for r in sequences.nucleotide_index(df).collect()}
    assert rows["a"] == {"id": "a", "length": 10, "A": 1, "C": 1, "G": 1, "T": 1, "N": 2, "other_IUPAC": 1, "-": 1, "?": 1, "invalid_nucleotides": 1}
    assert rows["b"]["length"] == rows["c"]["length"] == 0


def test_translation(spark):
    for text, amino in {"ATGGT-": "MX", "ATG---": "M-", "ATGTAG": "M*", "": ""}.items():
        assert one(spark, sequences.translated(F.lit(text))) == amino
    with pytest.raises(Exception, match="multiple of 3"):
        one(spark, sequences.translated(F.concat(F.lit("ATGT"), F.substring(F.col("id").cast("string"), 5, 1))))


def test_masking(spark):
    assert one(spark, sequences.masked(F.lit("ACGTAC"), 1, 1, [2, 99])) == "NCNTAN"
    assert one(spark, sequences.masked(F.lit("ACG"), 2, 2)) == "NNN"
    assert one(spark, sequences.masked(F.lit("AC!T"), invalid=True)) == "ACNT"


def test_distances(spark):
    weights = distance.DistanceMap()
    pairs = spark.createDataFrame([("1", "2", "g", "ACTG", "A--G"), ("3", "4", "g", "ACTGTA", "A--CCA")], "first string, second string, gene string, a string, b string")
    assert {r["first"]: r["distance"] for r in distance.pair_distances(pairs, weights).collect()} == {"1": 1.0, "3": 3.0}


def test_neighbours(spark):
    focal = spark.createDataFrame([("f", "ATCG")], "id string, sequence string")
    context = spark.createDataFrame([("f", "AAAA"), ("a", "ATCG"), ("b", "ANCG"), ("c", "ATCC"), ("d", "CCCC")], "id string, sequence string")
    found = proximity.neighbours(focal, context, 2, missing="all").collect()
    assert sorted((r["id"], r["distance"]) for r in found) == [("a", 0), ("b", 0)]


def test_titlecase(spark):
    df = spark.createDataFrame([("BRAINE-LE-COMTE, FRANCE",), (None,)], "place string")
    assert [r[0] for r in curate.titlecase(df, ["place"], articles=["le"]).collect()] == ["Braine-le-Comte, France", None]


def test_rename(spark):
    df = spark.createDataFrame([("x", "y")], "accession string, other string")
    out = curate.rename(df, [("accession", "id"), ("accession", "genbank_accession")])
    assert out.columns == ["id", "genbank_accession", "other"]
    assert curate.rename(df, [("accession", "other")]).columns == ["accession", "other"]
    assert curate.rename(df, [("accession", "other")], force=True).columns == ["other"]


def test_formats(spark):
    cases = [("2020-01", ["%Y", "%Y-%j", "%Y-%m"], "2020-01-01"), ("[2001 TO 2002]", [], "2001-01-01/2002-12-31"), ("never", [], "XXXX-XX-XX"), ("03 Feb 2021", ["%d %b %Y"], "2021-02-03"), ("2021-034", ["%Y-%j"], "2021-02-03")]
    for text, patterns, expected in cases:
        assert one(spark, formats.iso_date(F.lit(text), patterns)) == expected


def test_formats_without_a_year(spark):
    for text, pattern, expected in [("03/05", "%m/%d", "XXXX-XX-XX"), ("05", "%m", "XXXX-XX-XX"), ("2020 05", "%Y %d", "2020-XX-XX"), ("2020 10 1", "%Y %W %w", "2020-03-09")]:
        assert one(spark, formats.iso_date(F.lit(text), [pattern])) == expected


def test_authors(spark):
    cases = {"Lee et al": "Lee et al", "Lee et al.": "Lee et al.", "Marguet al": "Marguet al et al.", "A B; C": "A B et al.", "A & B": "A et al.", "A,B": "A et al.", "Sandand": "Sandand et al.", "": "?"}
    df = spark.createDataFrame([(k,) for k in cases], "authors string").withColumn("was", F.col("authors"))
    assert {r["was"]: r["authors"] for r in curate.abbreviate_authors(df).collect()} == cases


def test_repeated_ids_fail_a_merge(spark):
    x = spark.createDataFrame([("a", "1"), ("a", "2")], "id string, sequence string")
    with pytest.raises(Exception, match="more than once"):
        merge.merge_metadata({"X": (x, "id")}).collect()
    with pytest.raises(Exception, match="more than once"):
        merge.merge_sequences([x]).collect()


def test_collinear_changes(spark):
    rows = [(f"v{i}", "r", "s", f"change:{name}") for name, tests in {"a": range(20), "b": range(4, 22), "c": range(2, 20), "d": range(40, 42)}.items() for i in tests]
    found = dict(map(tuple, titers.collapse_collinear(spark.createDataFrame(rows, "test string, ref string, serum string, feature string"), 5).collect()))
    assert found == {"change:a": "change:a/change:c", "change:c": "change:a/change:c", "change:b": "change:b", "change:d": "change:d"}


def test_even_size_is_the_largest_that_fits():
    rng = np.random.default_rng(1)
    for _ in range(300):
        counts = rng.integers(1, 12, rng.integers(1, 6)).tolist()
        total = int(rng.integers(len(counts), 40))
        assert sampling.even_size(total, counts) == max(s for s in range(1, total + 1) if sum(min(s, c) for c in counts) <= total)


def test_location_rules():
    rules = {("a", "b", "c", "*"): ("1", "2", "3", "*"), ("a", "b", "*", "*"): ("1", "2", "*", "*"), ("a", "*", "*", "*"): ("1", "*", "*", "*")}
    assert curate.LocationRules(rules).apply(("a", "b", "x", "x"))[0] == ("1", "2", "x", "x")
    with pytest.raises(ValueError, match="cyclic"):
        curate.LocationRules({("a", "*", "*", "*"): ("b", "*", "*", "*"), ("b", "*", "*", "*"): ("a", "*", "*", "*")}).apply(("a", "", "", ""))


def test_merge(spark):
    x = spark.createDataFrame([("one", "X1a", "X1b", "X1c"), ("two", "X2a", "X2b", "X2c")], "id string, a string, b string, c string")
    y = spark.createDataFrame([("two", "", "Y2c", "Y2f"), ("three", "Y3b", "", "")], "id string, b string, c string, f string")
    rows = {r["id"]: r.asDict() for r in merge.merge_metadata({"X": (x, "id"), "Y": (y, "id")}, source_columns="s_{NAME}").collect()}
    assert rows["two"] == {"id": "two", "a": "X2a", "b": "X2b", "c": "Y2c", "f": "Y2f", "s_X": 1, "s_Y": 1}
    assert rows["three"]["s_X"] == 0


def test_query_language(spark):
    df = spark.createDataFrame([("a", "5", "x y"), ("b", "", "z"), ("c", "12", "x")], "id string, n string, `my col` string")
    ids = lambda text, **k: [r[0] for r in df.where(predicates.by_query(df, text, **k).passes).orderBy("id").collect()]
    assert ids("n >= 5") == ["a", "c"]
    assert ids("`my col`.str.contains('x') and not n == 12") == ["a"]
    assert ids("id in ['a', 'b']") == ["a", "b"]
    with pytest.raises(ValueError, match="do not exist"):
        ids("absent == 1")


def test_trees(spark):
    records = trees.parse_newick("((A:0.5,B:0.3)AB:0.8,C:0.3)ROOT:0.2;")
    nodes = tree.tree_frame(spark, records)
    steps = {(r["anc"], r["desc"]): r["steps"] for r in tree.closure(nodes).collect()}
    assert steps["ROOT", "A"] == 2 and steps["A", "A"] == 0 and ("C", "A") not in steps and len(steps) == 5 + 2 + 4
    div = {r["node"]: r["div"] for r in tree.cumulative_divergence(nodes).collect()}
    assert div["A"] == pytest.approx(1.3) and div["ROOT"] == 0
    assert {r["node"]: r["leaves"] for r in tree.leaf_counts(nodes).collect()} == {"A": 1, "B": 1, "C": 1, "AB": 2, "ROOT": 3}
    assert {r["name"] for r in trees.parse_newick(trees.write_newick(records))} == {"A", "B", "C", "AB", "ROOT"}
    with pytest.raises(ValueError, match="at least"):
        trees.parse_newick("(A,B);")
    rooted = tree.reroot_records(records, outgroup="C")
    assert next(r for r in rooted if r["name"] == "C")["parent"] == "_root"


def test_deep_chains(spark):
    """A chain of 10 000 nodes: no recursion, no closure."""
    edges = spark.range(10_000).select(F.format_string("n%05d", "id").alias("node"), F.when(F.col("id") > 0, F.format_string("n%05d", F.col("id") - 1)).alias("parent"), F.lit(1.0).alias("branch_length"))
    assert tree.nodes_of_edges(edges).agg(F.max("depth"), F.sum(F.col("is_tip").cast("int"))).first()[:] == (9999, 1)
    nodes = edges.withColumns({"tree_id": F.lit("t"), "is_tip": F.col("node") == "n09999"})
    assert tree.cumulative_divergence(nodes).agg(F.max("div")).first()[0] == 9999
    labels = spark.createDataFrame([("n00010", "a"), ("n05000", "b")], "node string, label string")
    assert sorted(map(tuple, tree.nearest_labelled(nodes, labels, "none").groupBy("label").count().collect())) == [("a", 4990), ("b", 5000), ("none", 10)]


def test_nexus():
    text = '#NEXUS\nBegin trees;\nTranslate 1 A, 2 B, 3 C;\ntree one = [&R] ((1[&rate=0.5,host="x"]:1,2:1):1,3[&host.set={"x","y"},host.set.prob={0.7,0.3}]:2);\nEnd;'
    found = {r["name"]: r["traits"] for r in trees.parse_nexus(text)}
    assert found["A"] == {"rate": 0.5, "host": "x"} and found["C"] == {"host_confidence": {"x": 0.7, "y": 0.3}}


def test_clade_definitions():
    rows = [("A", "nuc", 5, "T"), ("B", "clade", "A", ""), ("B", "nuc", 6, "G")]
    assert sorted(r for r in clades.inherited_definitions(rows) if r[0] == "B") == [("B", "nuc", 5, "T"), ("B", "nuc", 6, "G")]
    with pytest.raises(ValueError, match="cycle"):
        clades.inherited_definitions([("A", "clade", "B", ""), ("B", "clade", "A", "")])


def test_letters(spark):
    values = spark.createDataFrame([(0,), (25,), (26,), (52,), (18277,), (18278,), (475254,)], "n int")
    assert [r[0] for r in values.orderBy("n").select(clades.letters(F.col("n"))).collect()] == ["A", "Z", "AA", "BA", "ZZZ", "AAAA", "AAAAA"]


def test_dag():
    samples = dag.parse({"samples": {"c": {"context_sample": "b"}, "a": {}, "b": {"context_sample": "a"}}})
    assert [s.name for s in dag.ordered(samples)] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        dag.ordered(dag.parse({"samples": {"a": {"context_sample": "b"}, "b": {"context_sample": "a"}}}))


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("strain\tdate\ta\nx\t\t1\ny\t2020\t\n")
    df, key = readers.read_metadata(spark, str(tmp_path / "m.tsv"))
    assert key == "strain" and sorted(map(tuple, df.collect())) == [("x", "", "1"), ("y", "2020", "")]
    (tmp_path / "s.fasta").write_text(">a first\nAC\nGT\n>b\nTT\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "s.fasta")).collect())) == [("a", "a first", "ACGT"), ("b", "b", "TT")]
    (tmp_path / "m.bed").write_text("chrom\t0\t2\nchrom\t5\t6\n")
    assert sorted(r[0] for r in readers.read_bed_sites(spark, str(tmp_path / "m.bed")).collect()) == [0, 1, 5]
    (tmp_path / "ids.txt").write_text("a # note\n# none\n\nb\n")
    assert sorted(r[0] for r in readers.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "c.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tT,G\t.\t.\t.\tGT\t2\t0\n")
    assert list(map(tuple, readers.read_vcf(spark, str(tmp_path / "c.vcf")).collect())) == [("s1", "1", 4, "A", "G")]


def test_documents():
    document = {"version": "v2", "meta": {"colorings": [{"key": "x"}], "panels": ["tree"]}, "tree": {"name": "r", "node_attrs": {"div": 0}, "children": [{"name": "a", "node_attrs": {"div": -1}}]}}
    errors = export.document_errors(document)
    assert any("colouring" in e for e in errors) and any("falls" in e for e in errors)
    assert export.schema_errors({"a": 1}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}}}) == ["/ lacks 'b'", "/a is no string"]
    with pytest.raises(ValueError, match="repeated"):
        export.concatenated([{"key": "k"}, {"key": "k"}])
    assert writers.significant_of(1234.567) == 1235 and writers.significant_of(0.0012345) == 0.00123


def test_streams(spark, tmp_path):
    from strandmill.streaming import streams

    spark.createDataFrame([("a", " X "), ("a", "Y"), ("b", "Z")], "id string, v string").write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), "id string, v string")
    cleaned = streams.first_per_id(streams.curated(stream, lambda df: df.withColumn("v", F.trim("v"))), "id")
    streams.run_to_table(cleaned, "seen", "append", str(tmp_path / "checkpoint"))
    assert sorted(r["id"] for r in spark.table("seen").collect()) == ["a", "b"]
