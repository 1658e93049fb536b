"""The thin queries op1 to op13 over the input tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import audit, chat, extraction, media, minhash, mixing, packing, pii, quality, sharding, toxicity, vectors, whitening
from strandmill.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select("doc_id", "source", "lang", "n_chars", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = sharding.hilbert_shards(narrow, [("source", "hash"), ("lang", "hash"), ("n_chars", "log")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stores declare types by rule of thumb and are often wrong; here a hash of the bytes declares.
    said = F.element_at(F.array(*[F.lit(kind) for kind in ("audio/wav", "audio/flac", "image/png", "audio/wav")]), (F.crc32("media") % 4 + 1).cast("int"))
    stored = media.text_media(table(spark, sf_dir, "documents")).withColumn("declared", said)
    return media.digest(media.sniff_column(stored, "media", "declared"))


#: The conversation that the contract adds.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(ADDED, "conv_id long, turn int, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_turns(turns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "topic", "tokens", "probability", "kept")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_media": op6_media,
    "op7_chat": op7_chat,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_vectors": op10_vectors,
    "op11_audit": op11_audit,
    "op12_whitening": op12_whitening,
    "op13_extraction": op13_extraction,
}
ORACLES: dict[str, str] = {"op9_mixing": mixing.mixing_sql(), "op7_chat": chat.inst_sql(ADDED), "op11_audit": audit.audit_sql()}
