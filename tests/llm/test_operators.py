"""The ten operators: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandmill.llm import chat, components, media, minhash, mixing, packing, pii, quality, sharding, strings, tagger, toxicity, vectors  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string"
LONG = "word " * 40_000
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49, "x", "y"),
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49, "x", "y"),
    (2, "", None, None, 0, None, None),
    (3, None, "de", "a", None, None, None),
    (None, "no id here at all, mail me at joe@example.com", "en", "b", 4, "x", "y"),
    (4, LONG, "fr", "a", 200_000, "x", "y"),
    (5, "three words only", "fr", "b", 16, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(docs, TOKENIZER).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"],)):
        assert p["length"] & (p["length"] - 1) == 0 and len(p["ids"]) == 4 * p["length"] and p["offset"] == 0
        by_doc.setdefault(p["doc_id"], []).append(p)
    for key, text, *_ in ROWS:
        want = [*encode.encode(text or "", add_special_tokens=False).ids, 2]
        own = by_doc[key][: len(by_doc[key]) // sum(r[0] == key for r in ROWS)]
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).tolist() == want
        assert all(p["doc_tokens"] == len(want) for p in own)
    assert packing.split_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]
    assert packing.pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_tokenizer(name, by_word):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
    assert encode.by_word == by_word
    texts = ["don't, STOP's!! a.,b", "ÎÉ É. İstanbul ΑΣ", "x\ty\x1cz\x85q", "12.5,3½½.", "é ́a 日本語。", "'ll", "", "<|endoftext|> q", "a<|endoftext|>b <|ENDOFTEXT|>", "x <|startoftext|><|endoftext|>\ny"]
    for _ in range(2):
        for text, got in zip(texts, encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode([b"a \xff b"])[0], "<u4").tolist() == plain.encode("a \ufffd b", add_special_tokens=False).ids


def test_encoder_learns_words_together(monkeypatch):
    """Each word is encoded once for many batches in between, in few calls, with the tokenizer's ids."""
    from tokenizers import Tokenizer

    encode, plain = packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng, calls, encoded = random.Random(3), [], packing.Encoder.encoded
    monkeypatch.setattr(packing.Encoder, "encoded", lambda self, texts: calls.append(texts) or encoded(self, texts))
    words = ["".join(rng.choice("abcdeinorstuéÉßüñÄ") for _ in range(rng.randint(1, 20))) for _ in range(3000)] + ["s", "ll", "œuvre", "e\u0301t", "ǅ", "İx", "日本", "a1b", "don't", "×", "÷", "a÷b"]
    texts = [" ".join(rng.sample(words, 40)) + rng.choice([".", ", ", "'s", " 's"]) for _ in range(300)] + [" ".join(words)]
    want = [plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode([t.encode() for t in texts])] == want
    assert sum(map(len, calls)) < 600
    encode([t.encode() for t in texts])
    monkeypatch.setattr(packing, "REMEMBERED", 8000)
    encode.forget()
    calls.clear()
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode([t.encode() for t in texts])] == want
    assert not calls


def test_hilbert_curve(spark):
    for axes, bits in ((2, 3), (3, 2), (1, 3)):
        cells = spark.range(1 << axes * bits).select(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).alias(f"x{i}") for i in range(axes)])
        rows = cells.select("*", sharding.hilbert_index([F.col(f"x{i}") for i in range(axes)], bits).alias("h")).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(1 << axes * bits))
        assert all(sum(abs(p[i] - q[i]) for i in range(axes)) == 1 for p, q in zip(rows, rows[1:], strict=False))


def test_shards(spark, docs, empty):
    many = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(5).alias("n_chars"), F.lit("?").alias("shard"))
    dims = [("source", "hash"), ("lang", "hash"), ("n_chars", "log"), ("absent", "hash")]
    rows = sharding.hilbert_shards(many, dims).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert sharding.hilbert_shards(docs, dims).count() == len(ROWS)
    assert sharding.hilbert_shards(empty, dims).count() == 0


def similar(a, b, words_each=4):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        if not words:
            return set()
        return {tuple(words[i : i + words_each]) for i in range(len(words) - words_each + 1)} if len(words) >= words_each else {tuple(words)}

    x, y = shingles(a), shingles(b)
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def expected_components(rows):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if similar(a, b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 30, 120]))] for _ in range(6)]
    rows = []
    for i in range(160):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).upper() if i % 7 == 0 else "\t".join(text)))
    rows += [(200, ""), (201, None), (202, "a b"), (203, "A  B"), (204, LONG), (205, LONG + "x")]
    found = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words_each=4).collect()}
    want = expected_components(rows)
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert found[200]["n_shingles"] == found[201]["n_shingles"] == 0 and found[202]["n_shingles"] == 1


def test_near_duplicates_edges(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    lone = next(r for r in rows if r["doc_id"] is None)
    assert lone["component_id"] is None and lone["kept"]
    assert minhash.near_duplicates(empty).count() == 0


def test_signature_estimate(spark):
    x = np.random.default_rng(2).integers(0, 2**63, 1000, np.uint64)
    one, two = minhash.packed(minhash.minima(x[:900])), minhash.packed(minhash.minima(x[100:]))
    df = spark.createDataFrame([(one.view(np.int64).tolist(), two.view(np.int64).tolist())], "a array<long>, b array<long>")
    assert df.select(minhash.estimate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.8, abs=0.15)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (5, 4)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components.components(links).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}


def labelled(spark, n=240):
    """Invented documents: junk is bad, insults are toxic."""
    rng = random.Random(9)
    syllables = ["ta", "ren", "mi", "sol", "ke", "dar", "lu", "pon"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "schuft", "nebbich"]))
        if bad:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words) + ".", "en", "a", 1, "x", "y"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (10_000, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty):
    table, labels = labelled(spark)
    model = quality.fit(table, labels)
    rows = quality.score_quality(table, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.95
    edge = quality.score_quality(docs, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.fit(empty, labels) is None and quality.score_quality(empty, None).count() == 0


def test_toxicity(spark, docs, empty):
    table, labels = labelled(spark, 360)
    machine = toxicity.fit(table, labels)
    rows = toxicity.score_toxicity(table, machine).collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.95
    gapped, clean = machine.probabilities(toxicity.Sentences(machine.kernel).values(["tamisol grob-ian dar", "tamisol ken dar"]))
    assert gapped > 10 * clean
    assert toxicity.score_toxicity(docs, machine).count() == len(ROWS)
    assert toxicity.fit(empty, labels) is None and toxicity.score_toxicity(empty, None).count() == 0


def test_subsequence_kernel_against_brute_force():
    from itertools import combinations

    def brute(s, t, order, decay):
        def weights(x):
            out = Counter()
            for at in combinations(range(len(x)), order):
                out["".join(x[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(a[k] * b[k] for k in a)

    pairs = [("science", "essence"), ("abcab", "aabbc"), ("abc", "xyz"), ("aaaa", "aaaa")]
    got = strings.subsequence_kernel(strings.codes([p[0] for p in pairs]), strings.codes([p[1] for p in pairs]), 3, 0.5)
    assert got.tolist() == pytest.approx([brute(s, t, 3, 0.5) for s, t in pairs])


def test_media_round_trip(docs, empty):
    rows = {r["doc_id"]: r for r in media.digest(media.sniff_column(media.text_media(docs), "media")).collect()}
    for key, text, *_ in ROWS:
        body = (text or "").encode()
        payload = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        r = rows[key]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert media.sniff_column(media.text_media(empty), "media").count() == 0
    x = np.frombuffer((ROWS[0][1].encode()).ljust(64, b"\0"), np.uint8).astype(float)
    assert f"mean={x.mean():.4f},deviation={x.std():.4f}" in rows[1]["feature"] and rows[1]["feature"] != rows[5]["feature"]


def test_sniffing(spark):
    import gzip
    import io
    import wave
    import zipfile

    wav = media.encode_wav(b"abcd")
    with wave.open(io.BytesIO(wav)) as w:
        assert w.readframes(4) == b"abcd" and w.getsampwidth() == 1
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a", "hello")
    carved = b"junk" + gzip.compress(b"x" * 100) + b"more" + packed.getvalue() + b"tail"
    df = spark.createDataFrame([(0, bytearray(wav), "image/png"), (1, bytearray(carved), "audio/wav"), (2, None, None), (3, bytearray(b""), None), (4, bytearray(wav[:-2]), "audio/wav")], "k int, m binary, d string")
    rows = {r["k"]: r for r in media.sniff_column(df, "m", "d").collect()}
    assert rows[0]["sniffed"] == "audio/wav" and rows[0]["corrected"] and bytes(rows[0]["payload"]) == b"abcd"
    assert [c["kind"] for c in rows[1]["carved"]] == ["application/gzip", "application/zip"] and rows[1]["corrected"]
    assert rows[2]["sniffed"] is None and rows[3]["carved"] == [] and rows[4]["sniffed"] is None


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", "\\ back"), (1, 3, "assistant", "ö"), (2, 0, "system]", "s"), (2, None, "assistant", None), (None, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    rows = {r["conv_id"]: r for r in chat.digest(chat.format_turns(df)).collect()}
    one = "".join(f"{r}\n{t}\n" for c, _, r, t in turns if c == 1)
    assert rows[1]["turns_sha256"] == hashlib.sha256(one.encode()).hexdigest() and rows[1]["n_turns"] == 4
    assert rows[1]["loss_sha256"] == hashlib.sha256((said + "ö").encode()).hexdigest() and rows[1]["loss_chars"] == len(said) + 2
    assert rows[2]["turns_sha256"] == hashlib.sha256(b"assistant\n\nsystem]\ns\n").hexdigest()
    assert rows[3]["n_turns"] == 2 and None in rows and not any(r["rewrites"] for r in rows.values())
    whole = {r["conv_id"]: r for r in chat.formatted(chat.format_turns(df)).collect()}
    assert len(whole[1]["formatted"]) == rows[1]["formatted_chars"] and whole[1]["formatted"] == chat.inst_template([(r, t) for c, _, r, t in turns if c == 1])
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


def test_digest_wants_conversations_in_order(spark):
    df = spark.createDataFrame([(1, i, "user", "a") for i in range(4)], "conv_id long, turn int, role string, text string")
    turned = chat.format_turns(df).repartition(1).sortWithinPartitions(F.desc("place"))
    with pytest.raises(Exception, match="not in the order"):
        chat.digest(turned).collect()


def test_rewriting_template_is_detected(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn int, role string, text string")

    def forgets(messages):
        return f"({len(messages)})" + "".join(t for _, t in messages)

    assert [r["rewrites"] for r in chat.format_turns(df, forgets).orderBy("place").collect()] == [False, True, True]


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_against_brute_force():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("0012345.@+ -()ab%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text)


def test_network_spans_on_held_out_forms():
    """Precision and recall on labelled spans that no training window held, disguised ones included."""
    model, rng = tagger.trained(), random.Random(424_242)
    hits, found, wanted = 0, 0, 0
    for _ in range(400):
        kind, value = tagger._personal(rng)
        if kind == "card":
            value = next(value[:-1] + c for c in "0123456789" if pii.valid("card", value[:-1] + c))
        before, after = (" ".join(tagger._word(rng) for _ in range(4)) for _ in range(2))
        got = pii.network_spans(model, [f"{before} {value}, {tagger._look_alike(rng)} {after}."])[0]
        hits += (kind, len(before) + 1, len(before) + 1 + len(value)) in got
        found, wanted = found + len(got), wanted + 1
    assert hits / wanted >= 0.95 and hits / found >= 0.95
    text = "mail joe at example dot com or call (569) 555-3296, not 1999 or 12.05.2020"
    assert [(k, text[a:b]) for k, a, b in pii.network_spans(model, [text])[0]] == [("email", "joe at example dot com"), ("phone", "(569) 555-3296")]


def test_network_reads_every_character(monkeypatch):
    model = tagger.trained()
    plain = ["write to joe at example.com", "joe AT example DOT com or ann\tat\texample\tdot\torg"]
    found = pii.network_spans(model, plain)
    assert [[(k, t[a:b]) for k, a, b in f] for t, f in zip(plain, found, strict=True)] == [[("email", "joe at example.com")], [("email", "joe AT example DOT com"), ("email", "ann\tat\texample\tdot\torg")]]
    seen, emissions = [], tagger.Tagger.emissions
    monkeypatch.setattr(tagger.Tagger, "emissions", lambda self, x, lengths: seen.append(lengths.sum()) or emissions(self, x, lengths))
    assert pii.network_spans(model, ["only plain words " * 90, "", "and more"]) == [[], [], []] and sum(seen) >= 17 * 90 + 8


def test_network_spans_equal_one_path_over_the_whole_text(monkeypatch):
    """Whatever else is in the batch, and for texts in parts too."""
    model, rng = tagger.trained(), random.Random(5)
    texts = [" ".join(tagger.labelled_window(rng)[0] for _ in range(n)) for n in (1, 9, 40, 2, 17)] + ["x", "", "1" * 1500, "+1 2 " * 300, "a@b.c", "word " * 900 + "joe at example.com"]
    want = [pii._read(t, 0, model.decode(pii._blended(model, [tagger.char_classes(t)])[None])[0]) if t else [] for t in texts]
    assert pii.network_spans(model, texts) == want and sum(map(len, want)) > 50
    monkeypatch.setattr(pii, "HELD", 1200)
    assert pii.network_spans(model, texts) == want


def test_tagger_learns_from_labelled_spans():
    model = tagger.train(rows=1600, epochs=2)
    x, y = tagger._training_set(200, 77)
    assert (model.decode(model.emissions(x)) == y).mean() > 0.85


def test_personal_data(docs, empty):
    model = tagger.trained()
    x, y = tagger._training_set(300, 1234)
    assert (model.decode(model.emissions(x)) == y).mean() > 0.97
    text = "call +1 (569) 555-3296 4524132264652876 now"
    base, spans = pii.all_spans(model, [text])[0]
    assert base == brute_spans(text) == [] and [(k, text[s:e]) for k, s, e in spans] == [("card", "4524132264652876"), ("phone", "+1 (569) 555-3296")]
    assert pii.redacted(text, spans) == "call <PHONE> <CARD> now"
    rows = pii.find_pii(docs, model).collect()
    assert len(rows) == len(ROWS) and sum(r["n_email"] for r in rows) == 1
    assert pii.find_pii(empty, model).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["probability"] <= 1 for r in rows)
    assert mixing.mix(empty).count() == 0
    many = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40).alias("text"), F.when(F.col("id") % 10 < 8, "en").otherwise("de").alias("lang"), F.concat(F.lit("s"), F.col("id") % 5).alias("source")
    )
    mixture = mixing.Mixture(langs={"en": 0.5, "de": 0.5}, budget=0.3)
    kept = mixing.mix(many, mixture).where("kept").groupBy("lang").count().collect()
    shares = {r["lang"]: r["count"] for r in kept}
    assert shares["en"] / sum(shares.values()) == pytest.approx(0.5, abs=0.06)
    assert sum(shares.values()) == pytest.approx(1200, rel=0.1)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.vstack([c + 0.05 * rng.normal(size=(rng.integers(1, 9), 16)) for c in centres] + [np.repeat(centres[:1], 30, axis=0)])
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (None, [1.0] * 16), (905, [2.0] * 8)]
    found = vectors.near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()
    got = {r["vec_id"]: r for r in found}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T) >= 0.9
    assert [got[i]["n_links"] for i in range(len(x))] == (links.sum(axis=1) - 1).tolist()
    assert all(got[k]["n_links"] == 0 for k, _ in odd) and all(got[k]["component_id"] == k for k, _ in odd)
    assert sum(r["kept"] for r in found if r["vec_id"] is not None and r["vec_id"] < 900) == len({got[i]["component_id"] for i in range(len(x))})
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
