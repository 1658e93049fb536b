"""Checks of tables, reports of weighted groups, and filters that grouping brings along."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from strandmill.functions import dates
from strandmill.operators import checks, predicates, sampling
from strandmill.plans import dag
from strandmill.sources import readers


def test_policies_about_repeated_ids(spark, capsys):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 4), ("c", 5)], "id string, x int")
    assert checks.with_policy(df, "id", "silent").count() == 5
    assert checks.with_policy(df, "id", "warn").count() == 5
    assert "'a', 'b'" in capsys.readouterr().out
    with pytest.raises(ValueError, match="'a', 'b'"):
        checks.with_policy(df, "id", "error_all")
    with pytest.raises(ValueError, match="is repeated"):
        checks.with_policy(df, "id")
    with pytest.raises(ValueError, match="does not exist"):
        checks.with_policy(df, "name")
    with pytest.raises(ValueError, match="unknown policy"):
        checks.with_policy(df, "id", "loud")
    once = df.where("x > 3")
    assert all(checks.with_policy(once, "id", p).count() == 2 for p in checks.POLICIES)
    assert checks.with_policy(df.limit(0), "id").count() == 0


def test_long_reports_are_cut_in_the_message_only(spark):
    df = spark.range(300).selectExpr("cast(id % 150 as string) as id")
    with pytest.raises(ValueError, match="and others, 150 in all"):
        checks.with_policy(df, "id", "error_all")


def test_index_kind_and_cover(spark):
    index = spark.createDataFrame([("a", 0)], "id string, invalid_residues long")
    assert checks.check_index_kind(index, "aa") is index
    with pytest.raises(ValueError, match="invalid_nucleotides"):
        checks.check_index_kind(index, "nuc")
    found = checks.not_indexed(spark.createDataFrame([("a",), ("b",), ("b",)], "id string"), index)
    assert [r["id"] for r in found.collect()] == ["b"]


def test_names_of_alignment_and_tree(spark):
    one = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    two = spark.createDataFrame([("b",), ("c",), (None,)], "tip string")
    assert {tuple(r) for r in checks.name_differences(one, two).collect()} == {("alignment", "a"), ("tree", "c")}
    with pytest.raises(ValueError, match="only in the alignment: 'a'; names only in the tree: 'c'"):
        checks.check_names(one, two)
    checks.check_names(one, one)


def test_authors(spark):
    rows = [("s1", "x", "t", "j", 1), ("s2", "x", " t ", None, 2), ("s3", "x", "u", "", 3), ("s4", "y", "t", "j", 4), ("s5", "", "t", "j", 5), ("s6", None, "t", "j", 6)]
    df = spark.createDataFrame(rows, "strain string, authors string, title string, journal string, line int")
    tips = spark.createDataFrame([("s1",), ("s2",), ("s5",)], "node string")
    found = [r.asDict() for r in checks.author_info(df, tips, "strain", "line").collect()]
    assert found == [{"authors": "x", "n": 3, "title": "u", "journal": "", "contradictory": ["title", "journal"]}]
    assert checks.author_info(df.select("strain", "authors", "line"), tips, "strain", "line").first()["contradictory"] == []


def test_keys_of_rows(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"c": {"d": 1}}',), (None,), ("",)], "j string")
    assert {r[0] for r in checks.unique_keys(df, "j").collect()} == {"a", "b", "c"}
    assert checks.unknown_fields(df, "j", ["c", "d", "a"]) == ["d"]
    assert checks.unknown_fields(df, "j", []) == []


def test_dates_with_known_parts_after_unknown_ones(spark):
    texts = {"2000-01-01": None, "2000-01-XX": None, "2000-XX-XX": None, "2000-XX-01": "month", "200X-XX-01": "year", "200X-01-XX": "year", "XXXX-XX-XX": None, "2000": None, "": None, "2000-1X-XX": None, "2000-1X-05": "month"}
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    assert {r["d"]: r["e"] for r in df.select("d", dates.ambiguity_error(F.col("d")).alias("e")).collect()} == texts
    good = [t for t, e in texts.items() if e is None]
    assert [r[0] for r in df.where(F.col("d").isin(good)).select(dates.checked_ambiguity(F.col("d"))).collect()] == good
    with pytest.raises(Exception, match="its month is unknown"):
        df.where("d = '2000-XX-01'").select(dates.checked_ambiguity(F.col("d"))).collect()


def test_extent_of_an_annotation(spark, tmp_path):
    def written(name, *lines):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    source, gene = "c\t.\tsource\t1\t90\t.\t+\t.\tID=c", "c\t.\tgene\t4\t9\t.\t+\t.\tgene=g"
    assert readers.gff_extent(spark, written("a.gff", "##sequence-region c 1 90", source, gene)) == (0, 90)
    assert readers.gff_extent(spark, written("b.gff", source, gene)) == (0, 90)
    with pytest.raises(ValueError, match="disagree"):
        readers.gff_extent(spark, written("c.gff", "##sequence-region c 1 93", source, gene))
    with pytest.raises(ValueError, match="nothing says"):
        readers.gff_extent(spark, written("d.gff", gene))


def brute_sizes(counts, weights, fallback, places, total, rounding):
    """Sizes by forming all combinations first, as weights of every pair of a weighted value
    and the others' values, without those that have no rows."""
    values = {tuple(g[i] for i in places) for g in counts}
    others = {tuple(v for i, v in enumerate(g) if i not in places) for g in counts}
    made = {}
    for value, rest in itertools.product(values | set(weights), others):
        weight = weights.get(value, fallback)
        group = [None] * (len(value) + len(rest))
        rest = iter(rest)
        for i in range(len(group)):
            group[i] = value[places.index(i)] if i in places else next(rest)
        if tuple(group) in counts:
            made[tuple(group)] = (value, weight)
    peers = {v: sum(1 for w, _ in made.values() if w == v) for v, _ in made.values()}
    shares = {g: w / peers[v] for g, (v, w) in made.items()}
    whole = sum(shares.values())
    return {g: math.floor(s / whole * total + rounding) for g, s in shares.items()}


@pytest.mark.parametrize("columns", [["a"], ["a", "b"], ["b"]])
def test_weighted_sizes_against_all_combinations(spark, columns):
    by = ["a", "b"]
    counts = {(f"a{i}", f"b{j}"): 1 + i * j for i in range(4) for j in range(3) if (i + j) % 4}
    weights = {tuple(f"{c}{k}" for c in columns): 1.0 + k for k in range(2)} | {("z",) * len(columns): 9.0}
    table = spark.createDataFrame([(*g, n) for g, n in counts.items()], "group_a string, group_b string, n long")
    rows = [(*v, w) for v, w in weights.items()] + [(*["default"] * len(columns), 0.5)]
    given = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", weight double")
    found = sampling.weighted_sizes(table, given, columns, by, 37, F.lit(0.4))
    want = brute_sizes(counts, weights, 0.5, [by.index(c) for c in columns], 37, 0.4)
    assert {(r["group_a"], r["group_b"]): r["size"] for r in found.collect()} == want
    report = sampling.size_report(found).collect()
    assert all(r["output_size"] == min(r["input_size"], r["target_size"]) and r["under_sampled"] == (r["input_size"] < r["target_size"]) for r in report)
    assert {r["group_" + columns[0]] for r in sampling.unused_weights(table, given, columns).collect()} >= {"z"}


def test_values_without_a_weight(spark):
    table = spark.createDataFrame([("x", "u", 3), ("y", "u", 1), ("y", "v", 1)], "group_a string, group_b string, n long")
    given = spark.createDataFrame([("x", 1.0), ("q", 2.0)], "a string, weight double")
    assert [tuple(r) for r in sampling.weight_gaps(table, given, ["a"]).collect()] == [("a", "y")]
    assert tuple(sampling.skipped_groups(table, given, ["a"], ["a", "b"]).first()) == (4, 1, 3)
    with pytest.raises(Exception, match="no default: a=y"):
        sampling.weighted_sizes(table, given, ["a"], ["a", "b"], 10, F.lit(0.0)).collect()
    # A default in one of two columns is a value like others.
    two = spark.createDataFrame([("x", "default", 1.0), ("default", "default", 2.0)], "a string, b string, weight double")
    assert {tuple(r) for r in sampling.weight_gaps(table, two, ["a", "b"]).collect()} == {("a", "x"), ("a", "y"), ("b", "u"), ("b", "v")}
    assert sampling.weighted_sizes(table, two, ["a", "b"], ["a", "b"], 9, F.lit(0.0)).agg(F.sum("size")).first()[0] == 9
    assert sampling.weighted_sizes(table.limit(0), given, ["a"], ["a", "b"], 10, F.lit(0.0)).count() == 0


def test_vague_dates_leave_before_grouping(spark):
    df = spark.createDataFrame([("1", "2000-XX-XX"), ("2", "2000-02-XX"), ("3", "2000-02-03"), ("4", ""), ("5", None)], "strain string, date string")
    marked = predicates.attributed(df, sampling.grouping_filters(df, ["week"]))
    assert {r["strain"]: (r["filter"] or "").removeprefix("skip_group_by_with_ambiguous_") for r in marked.collect()} == {"1": "month", "2": "day", "3": "", "4": "year", "5": "year"}
    assert sampling.grouping_filters(df, ["strain"]) == []
    assert len(sampling.grouping_filters(df, ["year", "month"])) == 2
    plain = df.select("strain")
    assert predicates.kept(predicates.attributed(plain, sampling.grouping_filters(plain, ["month"]))).count() == 5
    samples = dag.parse({"samples": {"m": {"group_by": ["month"], "group_size": 9}}})
    assert {r["strain"] for r in dag.united(samples, dag.run(samples, df, "strain"), df, "strain").collect()} == {"2", "3"}


def test_rows_that_do_not_fit_their_header(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("name\tx\ty\na\t1\t2\n\nb\t\t\nc\t\"3\t4\"\t5\n")
    rows, key = readers.read_metadata(spark, str(path))
    assert key == "name" and [tuple(r) for r in rows.orderBy("name").collect()] == [("a", "1", "2"), ("b", "", ""), ("c", "3\t4", "5")]
    for line in ("d\t6", "d\t6\t7\t8"):
        path.write_text(f"name\tx\ty\na\t1\t2\n{line}\n")
        for used in (["name"], ["x"], ["y", "x"]):
            with pytest.raises(Exception, match="a row has no 3 cells: d\t6"):
                readers.read_metadata(spark, str(path))[0].select(*used).collect()
        assert readers.read_metadata(spark, str(path), strict=False)[0].count() == 2
    path.write_text("name\tx\n")
    assert readers.read_metadata(spark, str(path))[0].count() == 0
