"""Bytes that are no text, and columns of odd names."""

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandmill.llm import chat, pii, sharding, vectors  # noqa: E402

BAD = "cast(concat(x'FFFE20', cast('mail joe@example.com' as binary)) as string)"


def test_personal_data_in_bytes_that_are_no_text(spark):
    import corpus_pipeline

    docs = spark.sql(f"select 1L as doc_id, {BAD} as text, 'en' as lang, 's' as source, 5L as n_chars")
    row = pii.find_pii(docs).first()
    assert row["n_email"] == 1 and row["spans"] == "email:8:23"
    row = corpus_pipeline.without_personal_data(spark, docs, "").first()
    assert row["text"] == "�� mail <EMAIL>" and row["n_chars"] == 15


def test_chat_of_bytes_that_are_no_text(spark):
    turns = spark.sql(f"select 1L as conv_id, 0 as turn, 'user' as role, {BAD} as text union all select 1L, 1, 'assistant', cast(x'FF' as string)")
    row = chat.digest(chat.format_turns(turns)).first()
    assert row["n_turns"] == 2 and row["loss_chars"] == 1


def test_shards_of_columns_with_dots_and_clashing_names(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("a.b"), F.col("id").cast("string").alias("Shard"), (F.col("id") % 3).alias("c`d"))
    found = sharding.hilbert_shards(docs, [("a.b", "hash"), ("c`d", "log"), ("none", "hash")], shards=4)
    assert found.columns == ["doc_id", "a.b", "c`d", "hilbert", "shard", "slot"]
    assert sorted(r["count"] for r in found.groupBy("shard").count().collect()) == [10] * 4
    assert sharding.hilbert_shards(docs.limit(0), [("a.b", "hash")]).count() == 0


def test_vectors_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.02]), (None, [0.0, 0.0, 1.0])]
    found = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == len(rows)
