"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of ``documents``. In every stage other columns are handed on
whatever their names, unless they begin with ``_sm_``, texts of any length are
read whole, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import minhash, mixing, packing, pii, toxicity
from strandmill.llm.common import stored, table, whole


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject.

    Null and empty texts have no sentence and stay. Equal texts share a score, so
    repeated rows stay or go together. Null ids are scored like others. Without
    usable labels, or without any that stand out, nothing is rejected.
    """
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, machine, carry=docs.columns).where("_sm_predicted = 0").select(*whole(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words.

    Null and empty texts are copies of nothing and stay, and so do rows without a
    doc_id. Of equal texts under several ids the least id stays. Rows that repeat
    a kept id count as one document and stay together.
    """
    return minhash.without_near_duplicates(docs, words_each=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind's name in place of each span of personal data.

    A null text stays null, an empty one empty; n_chars becomes the new length in
    code points, null for a null text. Repeated rows change alike.
    """
    found = pii.find_pii(docs, redact=True, carry=docs.columns)
    changed = F.when(F.col("text").isNotNull(), F.col("_sm_redacted"))
    found = found.withColumn("text", changed)
    return (found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found).select(*whole(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics.

    Null sources and languages are values of their own, null texts have one token.
    Repeated rows share a draw, so they stay or go together.
    """
    return mixing.mix(docs, carry=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their ids; null and empty texts give the end id alone, and
    each repeated row gives sequences of its own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]
#: Trained models and a tokenizer decide the rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
