"""The pipeline's stages take effect, and queries agree with their SQL."""

import os

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strandmill.llm import queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_DIR)
        if name != "packing":
            assert after.columns == docs.columns
            after = corpus_pipeline.stored(after, f"test-{name}")
            assert 0 < after.count() <= before.count()
        before = after
    assert before.count() > 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Clashing names, nulls, empty and repeated rows, a long text, and no rows."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, Held_Out string, spans string, kept string, topic string, `a.b` string, redacted string"
    extra = ("s", "h", "sp", "k", "t", "ab", "r")
    rows = [(1, "mail joe@example.com now", "en", "a", 24, *extra), (1, "mail joe@example.com now", "en", "a", 24, *extra), (2, "", None, None, 0, *extra), (3, None, None, "b", None, *extra), (None, "x", "de", "a", 1, *extra), (4, "word " * 30_000, "en", "a", 150_000, *extra), (5, "word " * 30_000, "en", "a", 150_000, *extra)]
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, names)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            after = stage(spark, table, str(tmp_path))
            assert after.columns == docs.columns
            kept[name, table is docs] = [tuple(r) for r in after.collect()]
        assert kept[name, False] == []
    assert len(kept["toxicity", True]) == 7
    assert sorted(r[0] or 0 for r in kept["near_duplicates", True]) == [0, 1, 1, 2, 3, 4]
    redacted = {r[0]: r for r in kept["personal_data", True]}
    assert redacted[1][1] == "mail <EMAIL> now" and redacted[1][4] == len("mail <EMAIL> now") and redacted[3][1] is None and redacted[4][5:] == extra
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_chat_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"create view conversations as select * from '{SF_DIR}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    want = connection.sql(queries.ORACLES["op7_chat"])
    assert want.columns == names
    assert {tuple(r) for r in queries.QUERIES["op7_chat"](spark, SF_DIR).select(*names).collect()} == set(want.fetchall())


def test_mixing_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    got = {tuple(r) for r in queries.QUERIES["op9_mixing"](spark, SF_DIR).select("doc_id", "topic", "tokens", "probability", "kept").collect()}
    assert got == set(connection.sql(queries.ORACLES["op9_mixing"]).fetchall())
