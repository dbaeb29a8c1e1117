import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import html, langid, quality

DOCS = "doc_id long, text string, lang string, quality string"
STYLES = {"aa": "the and of ing tion", "bb": "der und ein lich keit", "cc": "les eux ment oi ié"}


def words(r, lang, n):
    parts = STYLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(2)
    return [(i, words(r, lang, r.choice([5, 60])), lang, "x") for i in range(300) for lang in [r.choice(list(STYLES))]]


def test_languages_of_held_out_documents(spark, docs):
    more = [(900, None, "aa", "x"), (901, "", None, "x"), (902, "12 34 !!", "aa", "x"), (None, "der und", "bb", "x"), (903, "ÜÖ", None, "x")]
    got = langid.held_out_languages(spark.createDataFrame(docs + more, DOCS)).collect()
    assert len(got) == len(docs) + len(more)
    truth = {d[0]: d[2] for d in docs}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by_id[903].lang_pred in STYLES and by_id[None].lang_pred in STYLES


def test_labels_of_held_out_rows_do_not_matter(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    other = [(i, t, "zz" if held(i) else lang, q) for i, t, lang, q in docs]
    a = langid.held_out_languages(spark.createDataFrame(docs, DOCS)).collect()
    b = langid.held_out_languages(spark.createDataFrame(other, DOCS)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_a_rare_language_is_learned(spark, docs):
    r = random.Random(12)
    rare = [(5000 + i, words(r, "cc", 40), "cc", "x") for i in range(12)]
    common = [d for d in docs if d[2] != "cc"]
    got = {x.doc_id: x for x in langid.held_out_languages(spark.createDataFrame(common + rare, DOCS), max_rows=60).collect()}
    assert sum(got[d[0]].lang_pred == "cc" for d in rare) >= 11


def test_few_languages(spark):
    one = spark.createDataFrame([(i, "der und", "bb", "x") for i in range(9)], DOCS)
    assert {r.lang_pred for r in langid.held_out_languages(one).collect()} == {"bb"}
    none = spark.createDataFrame([(1, "der und", None, "x")], DOCS)
    assert [(r.lang_pred, r.score) for r in langid.held_out_languages(none).collect()] == [("und", 0.0)]
    assert langid.held_out_languages(spark.createDataFrame([], DOCS)).collect() == []


def test_quality_keeps_clean_and_rejects_junk(spark, docs):
    r = random.Random(3)
    junk = [(1000 + i, "".join(w.upper() + r.choice(["!! ", "### "]) for w in words(r, "aa", 40).split()), "aa", "x") for i in range(60)]
    table = spark.createDataFrame(docs + junk + [(2000, None, None, None), (2001, "", None, None)], DOCS)
    labels = spark.createDataFrame([(i, 1, 5) for i in range(0, 300, 2)] + [(1000 + i, 0, 5) for i in range(0, 60, 2)] + [(4, 1, 5), (None, 1, 5), (6, None, 5)], "doc_id long, quality int, log_weight int")
    got = {x.doc_id: x.kept for x in quality.resample(table, labels).collect()}
    clean = [got[d[0]] for d in docs]
    assert sum(clean) >= 0.97 * len(clean) and sum(got[j[0]] for j in junk) <= 3
    assert got[2000] and got[2001]
    kept = quality.keep_selected(table.withColumn("log_weight", F.lit("mine")), labels)
    assert kept.columns == [*table.columns, "log_weight"]
    assert {x.doc_id for x in kept.collect()} == {i for i, k in got.items() if k}


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    table = spark.createDataFrame(docs[:5], DOCS)
    assert [x.kept for x in quality.resample(table, labels).collect()] == [True] * 5
    assert quality.resample(spark.createDataFrame([], DOCS), labels).collect() == []


def test_quality_of_odd_rows(spark, docs):
    """Repeated rows, ties, very long texts and clashing columns; one doc_id that holds a third of all rows."""
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(0, 1)] * 50, "doc_id long, quality int")
    long, same = (5000, words(random.Random(1), "aa", 60_000), "aa", "x"), (0, docs[0][1], "aa", "x")
    rows = docs + [same] * 150 + [long, (5001, "w" * 300_000, "aa", "x"), (None, docs[1][1], "aa", "x"), (None, docs[1][1], "aa", "x")]
    table = spark.createDataFrame([(*r, 1, 2.0, True) for r in rows], DOCS + ", k int, w double, kept boolean")
    got = quality.resample(table, labels).collect()
    assert len(got) == len(rows)
    assert len({(x.log_weight, x.kept) for x in got if x.doc_id == 0}) == 1 and len({(x.log_weight, x.kept) for x in got if x.doc_id is None}) == 1
    assert all(np.isfinite(x.log_weight) and x.kept is not None for x in got)
    kept = quality.keep_selected(table, labels)
    assert kept.columns == table.columns
    count = lambda it: sorted(str(i) for i in it)
    assert count(x.doc_id for x in kept.collect()) == count(x.doc_id for x in got if x.kept)


def test_languages_of_odd_rows(spark, docs):
    rows = [*docs, *docs[:40], *[docs[0]] * 100, (7000, words(random.Random(5), "bb", 60_000), "bb", "x"), (7001, "ß" * 200_000, "bb", "x")]
    table = spark.createDataFrame([(*r, "z", 0.5, True) for r in rows], DOCS + ", lang_pred string, score double, held_out boolean")
    got = langid.held_out_languages(table).collect()
    assert len(got) == len(rows) and len({(x.lang_pred, x.score) for x in got if x.doc_id == docs[0][0]}) == 1
    by_id = {x.doc_id: x.lang_pred for x in got}
    assert by_id[7000] == "bb" and by_id[7001] in STYLES


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies on this site.</p></div>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- x -->
<div id="wrap"><article><h1>A&nbsp;title &amp; more</h1><p>First <b>bo</b>ld&hellip;   text.<br>Line<p>Second &lt;p&gt; one is here.
<div class="ad">Buy now</div><ul><li>item one is long enough<li>item two</ul><form><input><p>Send it</p></form></article>
<aside class="sidebar"><p>Related things to read.</p></aside>
<div class="comments"><div class="comment"><p>Great article, I liked all of it.</p></div></div></div>
<footer>&copy; site</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "just text"), (5, None, "<article><h1>Open</h1><p>never closed"), (5, None, "<article><h1>Open</h1><p>never closed"), (6, "u", "<p>" * 3000 + "deep")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == "A title & more First bold… text. Line Second <p> one is here. item one is long enough item two"
    assert [by_id[i] for i in (2, 3, 4)] == ["", "", "just text"]
    assert by_id[5] == "Open never closed" and len(got) == 7
    assert all(r.n_chars == len(r.text) for r in got)


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    import itertools
    import math

    nodes = html.Tree("<div><p>a</p><section><p>b</p></section></div>").nodes
    r = random.Random(4)
    unary = [r.uniform(-2, 2) for _ in nodes]
    pair = [[[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(3)]
    kinds = [i % 3 for i in range(len(nodes))]
    total, one = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(u * v for u, v in zip(unary, y, strict=True)) + sum(pair[kinds[i]][y[n.parent]][y[i]] for i, n in enumerate(nodes) if n.parent >= 0)
        total += math.exp(s)
        for i, v in enumerate(y):
            one[i] += v * math.exp(s)
    m, _, log_z = html.marginals(nodes, unary, kinds, pair)
    assert log_z == pytest.approx(math.log(total))
    assert m == pytest.approx([x / total for x in one])


def test_model_on_other_labelled_pages():
    model, wrong, n = html.default_model(), 0, 0
    for page in html.labelled_pages(27, seed=5):
        t = html.Tree(page)
        x, kinds = html._vectors(t)
        m, _, _ = html.marginals(t.nodes, (x @ model[0]).tolist(), kinds, model[1])
        y = []
        for node in t.nodes:
            y.append(int(node.keep) if node.keep is not None else (y[node.parent] if node.parent >= 0 else 0))
        wrong += sum((a > 0.5) != bool(b) for a, b, node in zip(m, y, t.nodes, strict=True) if node.chars)
        n += sum(bool(node.chars) for node in t.nodes)
    assert wrong <= 0.02 * n


def test_page_text_of_plain_and_broken_markup():
    model = html.default_model()
    for page, text in (
        ("<p>a short line</p>", "a short line"),
        ("Intro<p>para</p>", "Intro para"),
        ("<ul><li>one<li>two</ul>", "one two"),
        ("<p>a &#x0000041;&#66; &amp;lt; &#" + "9" * 5_000 + ";</p>", "a AB &lt; �"),
        ("<p>a<![if x]>b<?php c?></p><p title=it's>d < e</p>", "ab d < e"),
        ("<p>a</p><!-- > --><p>b<!--></p><script>if (1 < 2) '</p>'</script ><p>c <a href='x", "a b c"),
        ("<p>a</p><script>never closed", "a"),
    ):
        assert html.main_text(page, model) == text, page[:60]


BODY = "<p>The river rose by two metres in the night, and the bridge was closed.</p><p>Nobody was hurt. The mayor spoke at noon to those who had to leave their homes.</p><p>Repairs will take a month, she said.</p>"
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul>'
SAID = " ".join(re.findall(r">([^<]+)</p>", BODY))


def test_page_text_whatever_the_classes_are_called():
    model = html.default_model()
    for page, text in (
        (f'<div class="site-content">{BODY}</div>', SAID),
        (f'<article class="story share-enabled">{BODY}</article>', SAID),
        (f'<article class="post comment-status-open">{BODY}</article>', SAID),
        (f'<article><h1>Law</h1>{BODY}<section class="legal"><p>The law of 1990 is cited here.</p></section></article>', f"Law {SAID} The law of 1990 is cited here."),
        (f'<div class="c1"><a href=/>Home</a> <a href=/>News</a> <a href=/>Sport</a></div><div class="c2">{BODY}</div>', SAID),
        (f'<div class="c1">{LINKS}</div><div class="c2"><h1>Flood</h1>{BODY}</div>', f"Flood {SAID}"),
        (f'<div class="werbung">Jetzt kaufen und sparen!</div><article><h1>Flut</h1>{BODY}</article>', f"Flut {SAID}"),
        (f"<article><header><h1>Flood</h1></header>{BODY}</article>", f"Flood {SAID}"),
        (f"<article><header><h1>Flood</h1><p>By A. Writer</p></header>{BODY}</article>", f"Flood By A. Writer {SAID}"),
        (f"<header><h1>Daily News</h1>{LINKS}</header><main><article><h1>Flood</h1>{BODY}</article></main><aside><h3>Related</h3>{LINKS}</aside><footer><p>&copy; 2020 Daily News.</p></footer>", f"Flood {SAID}"),
        (f'<div class="navigation">{LINKS}</div><div class="spalte1"><h1>Flut</h1>{BODY}</div><div class="spalte2"><h3>Meist gelesen</h3>{LINKS}</div><div id="kommentare"><h3>Kommentare</h3><p>Sehr gut!</p></div>', f"Flut {SAID}"),
        (f'<div id="page"><div id="content" class="site-content"><article id="post-12" class="post-12 post type-post status-publish"><h1 class="entry-title">Flood</h1><div class="entry-content">{BODY}</div><footer class="entry-footer">Posted in News</footer></article><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol><li><p>Great article, I liked it.</p></li></ol></div></div><div id="secondary" class="widget-area"><p>About me: I write here every day.</p></div></div>', f"Flood {SAID}"),
        (f"<table><tr><td>{LINKS}</td><td><h1>Flood</h1>{BODY}</td></tr></table>", f"Flood {SAID}"),
        (f'<nav>{LINKS}</nav><article><h1>Flood</h1><p>Short one.</p></article><div class="ad">{BODY}</div><footer>x</footer>', "Flood Short one."),
        (f'<section class="publicite"><p>Achetez maintenant.</p></section><main class="contenu"><h1>Crue</h1>{BODY}</main><section class="commentaires"><h3>Avis</h3><p>Merci beaucoup.</p></section>', f"Crue {SAID}"),
        (f"<div>{BODY}</div><div><h2>Later</h2>{BODY}</div>", f"{SAID} Later {SAID}"),
        (f"<div><h1>Flood</h1><div>{BODY}</div><div><h2>Later</h2><p>It ended well for all.</p></div></div>", f"Flood {SAID} Later It ended well for all."),
    ):
        assert html.main_text(f"<html><body>{page}</body></html>", model) == text, page.replace(BODY, "BODY").replace(LINKS, "LINKS")


def test_forest_and_tree_marginals_agree():
    r = random.Random(6)
    trees = [html.Tree(p).nodes for p in html.labelled_pages(12, seed=3)]
    pair = [[[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(3)]
    parent, unary, kinds, want, both = [], [], [], [], []
    for nodes in trees:
        u, k = [r.uniform(-2, 2) for _ in nodes], [r.randrange(3) for _ in nodes]
        m, pm, _ = html.marginals(nodes, u, k, pair)
        parent += [n.parent + len(want) if n.parent >= 0 else -1 for n in nodes]
        want, both, unary, kinds = want + m, both + pm, unary + u, kinds + k
    parent = np.array(parent)
    got, joint = html.forest_marginals(parent, html._depths(parent), np.array(unary), np.array(kinds), np.array(pair))
    assert got.tolist() == pytest.approx(want)
    assert all(joint[i].tolist() == [pytest.approx(x) for x in b] for i, b in enumerate(both) if b)


def test_broken_markup_takes_linear_time():
    model = html.default_model()
    for piece in ("<", "<a ", "<!--", "<![", "<p a='", '<p a="', "<title>", "</", "&#"):
        html.main_text(piece * 100_000, model)
    html.main_text("<div>" * 20_000 + "</p>" * 20_000, model)


def test_html_head_without_end():
    model = html.default_model()
    for page, text in (
        ("<html><head><title>T</title><p>Article text here, first.<p>Second one.", "Article text here, first. Second one."),
        ("<head><title>T</title>Plain words", "Plain words"),
        ("<head><meta charset=x><title>a</title><script>x()</script><style>b</style><noscript><p>no</p></noscript>\n<p>Text kept here.</p>", "Text kept here."),
        ("<head><head><title>a</title></head><body><p>Text kept here.</p>", "Text kept here."),
        ("<head><noscript><p>no<title>a</title></head><body><p>Text kept here.</p>", "Text kept here."),
        ("<head><title>a<body><p>Text kept here.</p>", "Text kept here."),
        ("<p>Sum <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds.", "Sum x=2 holds."),
    ):
        assert html.main_text(page, model) == text, page


def test_ftrl_step_by_step():
    """Weights of twenty rows against a plain loop over coordinates."""
    import math

    r = random.Random(9)
    rows = []
    for _ in range(20):
        at = sorted(r.sample(range(60), 8))
        rows.append((r.randrange(3), np.array(at, dtype=np.int64), np.array([r.uniform(0.1, 1) for _ in at])))
    z, n = {}, {}

    def weight(i, k):
        v = z.get((i, k), 0.0)
        return 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n.get((i, k), 0.0))) / langid.ALPHA + langid.L2)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(rows)):
            y, at, val = rows[i]
            x = [*zip(at.tolist(), val.tolist(), strict=True), (langid.BUCKETS, 0.5)]
            logits = [sum(v * weight(j, k) for j, v in x) for k in range(3)]
            top = max(logits)
            p = [math.exp(t - top) for t in logits]
            p = [q / sum(p) for q in p]
            before = {(j, k): weight(j, k) for j, _ in x for k in range(3)}
            for j, v in x:
                for k in range(3):
                    g = v * (p[k] - (k == y))
                    old = n.get((j, k), 0.0)
                    z[j, k] = z.get((j, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * before[j, k]
                    n[j, k] = old + g * g
    got, bias = langid._ftrl(rows, 3)
    for j in range(60):
        assert got[j].tolist() == pytest.approx([weight(j, k) for k in range(3)], abs=1e-6)
    assert bias.tolist() == pytest.approx([0.5 * weight(langid.BUCKETS, k) for k in range(3)])
    assert (got == 0).sum() > 0  # the first penalty leaves weights out


def test_ngram_counts_by_plain_strings():
    texts = ["Ab 12 ab", "", "été, été!", "x"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = langid._counts(np.frombuffer(data, dtype=np.uint8), offsets)
    for row, t in zip(got, texts, strict=True):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = re.sub(" +", " ", s)
        want = {}
        for k in langid.ORDERS:
            for i in range(len(s) - k + 1):
                h = 0
                for c in s[i : i + k]:
                    h = (h * 0x9E3779B97F4A7C15 + int.from_bytes(c.encode(), "big")) % 2**64
                b = int(langid.mix64(np.array([(h + k - 1) % 2**64], dtype=np.uint64))[0]) % langid.BUCKETS
                want[b] = want.get(b, 0) + 1
        assert {i: int(v) for i, v in enumerate(row) if v} == want, t


def test_gumbel_top_k_by_brute_force(spark, docs):
    table = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)], "doc_id long, quality int")
    model, scored = quality.fit(table, labels)
    rows = scored.select("doc_id", "log_weight", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 52)).alias("u")).collect()
    key = {r.doc_id: r.log_weight - np.log(-np.log((r.u + 0.5) / 2**52)) for r in rows}
    k = sum(r.log_weight >= model.level for r in rows)
    best = sorted(key, key=key.get, reverse=True)[:k]
    assert {r.doc_id for r in quality.resample(table, labels).collect() if r.kept} == set(best)
    # The weight of each text is the tempered log ratio of the two models over its words and word pairs.
    from marlstone.llm.common import runs_of, words_of

    for r, d in zip(sorted(rows, key=lambda r: r.doc_id)[:40], sorted(docs)[:40], strict=True):
        b = np.frombuffer(d[1].encode(), dtype=np.uint8)
        h = words_of(b, np.array([0, len(b)]))[2]
        f = [int(x) % quality.BUCKETS for x in [*h, *runs_of(h, 2)]]
        assert r.doc_id == d[0] and r.log_weight == pytest.approx(quality.LENGTH * sum(model.log_ratio[i] for i in f) / (len(f) + quality.SHRINK))
