"""Filter audit, whitening and extraction: brute force, exact arithmetic, edge cases."""

import itertools
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import audit, dom, extraction, page_layouts, whitening

DOCS = "doc_id long, text string, lang string, part string, mask int, count long, good int, toxic int, n long"
LABELS = "doc_id long, quality int, toxic int, mask int"
LONG = " ".join(f"w{i}" for i in range(50_000))
ROWS = [
    (5, LONG, "en", "x", 1, 1, 1, 1, 1), (3, LONG, "en", "x", 1, 1, 1, 1, 1), (3, LONG, "en", "x", 1, 1, 1, 1, 1), (9, LONG, None, "x", 1, 1, 1, 1, 1),
    (1, "", "de", None, None, None, None, None, None), (2, None, "", None, None, None, None, None, None), (None, "no id", "de", "y", 1, 1, 1, 1, 1),
    (None, LONG, "de", "y", 1, 1, 1, 1, 1), (7, "AB cd \x0bef gh $ \U0001f600", "en", "y", 1, 1, 1, 1, 1), (8, "same " * 200, "en", "y", 1, 1, 1, 1, 1),
]
MARKS = [(5, 1, 0, 1), (9, 1, 1, 1), (9, 0, None, 1), (None, 1, 1, 1), (2, None, 1, 1)]


def brute(rows, marks):
    """The audit by its definition, on Python lists."""
    fails, docs = [], [(r[0], r[1] or "", r[2] or "") for r in rows]
    for doc_id, text, part in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(o is not None and o < doc_id and t == text for o, t, _ in docs),
        }
        good = any(m[0] == doc_id and m[1] == 1 for m in marks if m[0] is not None)
        toxic = any(m[0] == doc_id and m[2] == 1 for m in marks if m[0] is not None)
        fails.append((part, own, good, toxic))
    out = []
    for part in {f[0] for f in fails}:
        here = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                out_now = [f for f in left if f[1][letter]]
                gone = [f for f in here if any(f[1][e] for e in order[: step - 1])]
                left = [f for f in left if not f[1][letter]]
                shapley[letter] += len(out_now)
                unique = sum(f[1][letter] and sum(f[1].values()) == 1 for f in here)
                steps.append((letter, (part, "".join(order), step, len(left), len(out_now), sum(f[1][letter] for f in gone), unique, sum(f[2] for f in out_now), sum(f[3] for f in out_now))))
        out += [(*row, shapley[letter]) for letter, row in steps]
    return sorted(out)


@pytest.mark.parametrize("held", [audit.HELD_BYTES, 1])
def test_audit_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(audit, "HELD_BYTES", held)
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    labels = spark.createDataFrame(MARKS, LABELS)
    assert sorted(map(tuple, audit.filter_audit(docs, labels).collect())) == brute(ROWS, MARKS)


def test_audit_sql_says_the_same(spark):
    rows, marks = spark.createDataFrame(ROWS, DOCS).toPandas(), spark.createDataFrame(MARKS, LABELS).toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    con.register("labels", marks)
    columns = ["part", "filter_order", "step", *audit.COUNTS]
    assert sorted(con.sql(f"select {', '.join(columns)} from ({audit.audit_sql()})").fetchall()) == brute(ROWS, MARKS)


def test_audit_of_one_hot_text_and_colliding_fingerprints(spark, monkeypatch):
    docs = spark.range(4000).select("id", (3999 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text"), F.lit("en").alias("lang"))
    masks = audit.document_masks(docs.repartition(5))
    passing = {r["doc_id"] for r in masks.where((F.col("mask").bitwiseAND(audit.REPEATED)) == 0).collect()}
    least = {r["doc_id"] for r in docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).collect()}
    assert passing == least and masks.agg(F.sum("count")).first()[0] == 4000
    chains = audit.Chains()
    assert chains.add(1, b"a", 5, {("en", 1): 1}) == [] == chains.add(1, b"b", 4, {("en", 1): 1})
    assert chains.add(1, b"a", 2, {("en", 3): 1}) == [(5, {("en", 1): 1})] and chains.add(1, b"b", 9, {("en", 1): 2}) == [(9, {("en", 1): 2})]


def test_audit_of_nothing_and_of_no_text(spark):
    assert audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    docs = spark.sql("select 1L as doc_id, cast(x'FFFE2041' as string) as text, 'en' as lang")
    assert [(r["mask"], r["count"]) for r in audit.document_masks(docs).collect()] == [(5, 1)]
    named = docs.selectExpr("doc_id", "text", "lang as `a.b`", "1 as Part")
    assert audit.filter_audit(named, part="a.b").select("part").distinct().collect()[0][0] == "en"


VECTORS = "vec_id long, embedding array<float>, n int, component int"


def exact(rows):
    """Integers, sums and scatter by Fractions."""
    x = [[int((Fraction(float(c)) * 64).__floor__()) + 1_000_000 for c in np.float32(v)] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    return x, s, v


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3).astype(np.float32)
    data = [(i, v.tolist(), 1, 1) for i, v in enumerate(rows)]
    dropped = [(900, None, 1, 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 1), (902, [float("nan")] * 6, 1, 1), (903, [float("inf")] * 6, 1, 1), (904, [1.0, 2.0], 1, 1), (905, [], 1, 1)]
    twice = [(None, rows[0].tolist(), 1, 1), (0, rows[0].tolist(), 1, 1)]
    df = spark.createDataFrame(data + dropped + twice, VECTORS).repartition(5)
    found = whitening.whitened(df).toPandas()
    x, s, v = exact([*rows, rows[0], rows[0]])
    n = len(x)
    assert set(found["n"]) == {n} and len(found) == n * 6 and found["vec_id"].isna().sum() == 6
    want = {i: sum((n * c - s[j]) ** 2 for j, c in enumerate(x[i])) for i in range(300)}
    assert all(want[int(r.vec_id)] == r.deviation for r in found.dropna().itertuples())
    values = np.linalg.eigvalsh(v)[::-1]
    assert found.groupby("component")["explained"].first().to_numpy() == pytest.approx(values / np.trace(v), rel=1e-9)
    w = found.dropna().drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    w = np.vstack([w, w[0], w[0]])
    error = np.abs(w.T @ w / n - np.eye(6)).max()
    assert error < 1e-9 and abs(found["identity_error"].iloc[0] - error) < 1e-9
    # Principal directions: V times a component is its eigenvalue times the component.
    centred = np.array(x, dtype=float) - np.array(s) / n
    loadings = centred.T @ w / n
    assert v @ loadings == pytest.approx(loadings * values, rel=1e-6, abs=1e-6 * values[0])


def test_whitening_stays_exact_far_from_zero(spark):
    big = [[2.0**40 + i * 2.0**20, -(2.0**40), float(i % 3) * 2.0**10] for i in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>").repartition(4)
    x = [[int(c) * 64 + 1_000_000 for c in v] for v in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    found = {r["vec_id"]: r for r in whitening.whitened(df).where("component = 1").collect()}
    want = [sum((50 * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    assert [found[i]["deviation"] for i in range(50)] == [w if w < 2**63 else None for w in want]
    # The constant second dimension leaves two components.
    assert whitening.whitened(df).select("component").distinct().count() == 2
    rng = np.random.default_rng(2)
    block = rng.integers(-(2**59), 2**59, (40, 3))
    assert (whitening.cross_products(block) == block.astype(object).T @ block.astype(object)).all()
    huge = whitening.integers(np.array([[1e300, -1.0]]))
    assert huge[0][0] == int(64e300) + 1_000_000 and (whitening.cross_products(huge - 1_000_000) == (huge - 1_000_000).T @ (huge - 1_000_000)).all()


def test_whitening_without_rows_or_variance(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 1, 1), (2, [], 1, 1)], VECTORS)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, 1) for i in range(5)], VECTORS)
    assert whitening.whitened(same).count() == 0
    wide = spark.createDataFrame([(i, [float(j == i) for j in range(40)], 1, 1) for i in range(45)], VECTORS)
    assert whitening.whitened(wide).select("component").distinct().count() == 32


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<div class="cookie-notice"><p>We use cookies on this site, as all do.</p><button>Ok</button></div>
<header id="masthead"><a href="/">Site</a><p>A tagline of the site</p><form class=search><label>Find</label><input></form></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a><li><a href="/c">More</a></ul></nav>
%s
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story here</a></li><li><a href="/y">Another one</a></li></ul></aside>
<section id="comments"><h3>2 Comments</h3><div class="comment"><b>Joe</b><p>I liked this text a lot, thanks.</p></div><div class="comment"><b>Ann</b><p>I did not like it.</p></div></section>
<form class="newsletter"><p>Subscribe to our letter today.</p><input name=mail></form>
<footer>&copy; Site &middot; All rights reserved. <a href="/imprint">Imprint</a></footer></body></html>"""
BODY = """<h1>A  title &amp; more</h1><p>First para&shy;graph with <b>bo</b>ld, a<br>break, &eacute;t&eacute; and
 much   more to say, as texts do.<p>Second one, not closed: it says &lt;b&gt; and 3 < 4.
<div class="ad">Buy this now!</div><ul><li>An item of the text</li><li>And one more item</ul><blockquote>Somebody said so, long ago.</blockquote>
<p title="a > b">Last paragraph, which is as long as the first one was, or nearly so.</p>"""
WANT = "A title & more First para­graph with bold, a break, été and much more to say, as texts do. Second one, not closed: it says <b> and 3 < 4. An item of the text And one more item Somebody said so, long ago. Last paragraph, which is as long as the first one was, or nearly so."


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>', '<div class="wrap"><div class="post-body">%s</div></div>', "<main><article>%s</article></main>"])
def test_extraction_of_a_page(frame):
    assert extraction.trained()([PAGE % (frame % BODY)]) == [WANT]


def test_extraction_of_unseen_layouts():
    pages, _, want = extraction.examples(range(10**7, 10**7 + 200))
    markups = [page_layouts.Layout(seed).page().replace(page_layouts.MARK, "") for seed in range(10**7, 10**7 + 200)]
    got = extraction.trained()(markups)
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.8
    kept = sum(len(set(g.split()) & set(w.split())) for g, w in zip(got, want, strict=True))
    assert kept > 0.97 * sum(len(set(w.split())) for w in want) and kept > 0.97 * sum(len(set(g.split())) for g in got)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(4)
    for _ in range(60):
        page, n = dom.Page(), int(rng.integers(1, 9))
        for i in range(n):
            page.add(int(rng.integers(0, i)) if i else -1, 0, 0, 0, 0, None)
        scores = rng.normal(size=n).tolist()
        kept = extraction.decoded(page, scores)
        sound = [c for c in itertools.product([False, True], repeat=n) if all(not c[i] or c[page.parent[i]] for i in range(1, n))]
        value = lambda c: sum(s for s, k in zip(scores, c, strict=True) if k)  # noqa: B023, E731
        assert tuple(kept) in sound and value(kept) == pytest.approx(max(map(value, sound)))


def test_extraction_edge_cases(spark):
    deep = "<div>" * 30_000 + "<p>x" + "</div>" * 30_000
    odd = ["<", "<p", "</p></p>", "<!--", "<script>", "&#xD800;&#0;&bogus;", "<a href='", "</ >", "<p =\"a>b", "\x00", deep, "<article><p>" + "word " * 100_000]
    rows = [(i, "u", m, "t", 1) for i, m in enumerate([None, "", *odd])] + [(0, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").withColumn("a.b", F.lit(1))
    found = extraction.main_texts(df).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert [r["text"] for r in found if r["page_id"] in (0, 1)] == [""] * 4
    assert max(r["n_chars"] for r in found) == 499_999
    assert extraction.main_texts(df.limit(0)).count() == 0
    assert extraction.main_texts(spark.sql("select cast(x'FF' as string) as html, 1 as page_id")).count() == 1
