"""Operators on training data do the whole job at their bounds."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandmill.llm import chat, common, packing, strings, toxicity, vectors  # noqa: E402


def test_toxicity_values_survive_forgetting(monkeypatch):
    kernel = strings.LandmarkKernel(["grobian", "schuft"])
    rng = random.Random(1)
    texts = [f"du schuft {rng.randrange(10**6)}. ein grobian {rng.randrange(10**6)}" for _ in range(40)]
    want = toxicity.Sentences(kernel).values(texts)
    assert all(len(rows) == 2 for rows in want)
    for bound in (1, 7, 12, 30):
        monkeypatch.setattr(toxicity, "REMEMBERED", bound)
        sentences = toxicity.Sentences(kernel)
        got = [sentences.values([text])[0] for text in texts]
        assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_vector_pairs_in_a_cone_meet(spark):
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    axis = np.eye(64)[:1]
    x = unit(np.sqrt(0.8) * axis + np.sqrt(0.2) * unit(rng.normal(size=(5000, 64)) * (np.arange(64) > 0)))
    aside = x[200:400] - np.einsum("ij,ij->i", x[200:400], x[:200])[:, None] * x[:200]
    y = 0.905 * x[:200] + np.sqrt(1 - 0.905**2) * unit(aside)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, y]))]
    found = {r["vec_id"]: r["component_id"] for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([found[i] == found[5000 + i] for i in range(200)]) >= 0.93


def conversation(spark, n):
    return spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)], "conv_id long, turn int, role string, text string")


def test_chat_renders_true_prefixes(spark):
    def last_forty(messages):
        return "".join(f"[{text}]" for _, text in messages[-40:])

    df = conversation(spark, 45)
    found = [r["rewrites"] for r in chat.format_turns(df, last_forty).orderBy("place").collect()]
    assert found == [False] * 40 + [True] * 5
    narrow = chat.format_turns(df, last_forty, window=8)
    assert [r["rewrites"] for r in narrow.orderBy("place").collect()] == [False] * 9 + [None] * 36
    assert chat.digest(narrow).first()["rewrites"] is None and chat.formatted(narrow).first()["rewrites"] is None
    last_forty.additive = True
    with pytest.raises(Exception, match="marked additive"):
        chat.format_turns(df, last_forty).collect()


def test_pipeline_takes_five_words(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(44)]
    other = [*words[:20], "changed", *words[21:]]
    columns = "doc_id long, text string"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], columns)
    assert corpus_pipeline.without_copies(spark, docs, "").count() == 2


def test_toxicity_takes_bytes_that_are_no_text(spark):
    kernel = strings.LandmarkKernel(["grobian", "schuft"])
    machine = toxicity.Machine(kernel, np.ones(kernel.root.shape[1]), -0.5, 4.0, 0.0)
    docs = spark.sql("select 1L as doc_id, cast(concat(x'FFFE20', cast('ein grobian' as binary)) as string) as text union all select 2L, cast(x'FF' as string)")
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, machine).collect()}
    assert found[1] > 0.5 > found[2]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None


def test_forgetting_words_leaves_ids_alone(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"Some words, {i} unforgettable{i} ones <|endoftext|>".encode() for i in range(40)]
    want = packing.Encoder(path)(texts)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    encode = packing.Encoder(path)
    assert [encode([text])[0] for text in texts] == want
    encode.forget()
    assert encode(texts) == want


def test_tables_reach_python_in_bounded_batches(spark, tmp_path):
    spark.range(0, 9000, 1, 1).selectExpr("id as doc_id", "repeat('x', 2000) as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.conf.getAll.get(common.BATCH_SETTING)
    try:
        spark.conf.unset(common.BATCH_SETTING)
        docs = common.table(spark, str(tmp_path), "documents")
        sizes = [r.n for r in docs.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert max(sizes) <= 2 * common.BATCH_BYTES and sum(sizes) >= 9000 * 2000
        spark.conf.set(common.BATCH_SETTING, 1 << 20)
        common.table(spark, str(tmp_path), "documents")
        assert int(spark.conf.get(common.BATCH_SETTING).rstrip("b")) == 1 << 20
    finally:
        spark.conf.unset(common.BATCH_SETTING)
        if kept:
            spark.conf.set(common.BATCH_SETTING, kept)


def test_mixing_plans_hold_one_step_each(spark, monkeypatch):
    from strandmill.llm import mixing

    def counted(df, label):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return common.stored(df, label)

    joins = []
    monkeypatch.setattr(mixing, "stored", counted)
    docs = spark.createDataFrame([(i, f"text {i}", "en" if i % 3 else "de", f"s{i % 4}") for i in range(20)], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs).count() == 20
    assert max(joins) <= 2


def test_tagger_spends_nothing_on_rows_that_have_ended():
    from strandmill.llm import tagger

    model = tagger.trained()
    w, rng = model.weights, np.random.default_rng(5)
    lengths = np.array([90, 90, 40, 7, 1])
    x = rng.integers(0, tagger.PADDING, (5, 90))
    x[np.arange(90) >= lengths[:, None]] = tagger.PADDING
    for order in ([0, 1, 2, 3, 4], [3, 0, 4, 1, 2]):
        got = tagger._emissions(x[order], lengths[order], w["x"], w["h"], w["out"])
        for row, i in enumerate(order):
            n = lengths[i]
            assert np.abs(got[row, :n] - tagger._emissions(x[i : i + 1, :n], lengths[i : i + 1], w["x"], w["h"], w["out"])[0]).max() < 1e-3
    got = tagger._emissions(x, lengths, w["x"], w["h"], w["out"])
    assert not any(got[i, n:].any() for i, n in enumerate(lengths))
