"""BPE, HTML, exact search, quality and language: against libraries, brute force and held-out rows."""

import base64
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bpe, html_wrapper, kdtree, langid, quality

DOCS = "doc_id long, text string"


def test_bpe_as_tiktoken(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "Hello  world\n\n x", "éàü 你好 🙂", "a" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>", "don't I'll"] + ["".join(rng.choice("abé1 \n\t.!🙂") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], DOCS).withColumn("ids", F.lit("clash"))
    out = {r["doc_id"]: (list(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(docs, path, P.PATTERN).collect()}
    assert out == {i: (enc.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)} | {999: ([], b"")}
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.collect()}[2] == texts[2]
    assert bpe.encode_decode(docs.limit(0), path, P.PATTERN).count() == 0


PAGE = '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p>One  two<br><p><b>three</p><ul><li>four<li>five</ul></article><div id="comments">bad</div><footer>end</footer></body></html>'


def test_html_article():
    assert html_wrapper.main_text(PAGE) == "Head & more\nOne two\nthree\nfour\nfive"
    assert html_wrapper.main_text(None) == html_wrapper.main_text("") == ""
    assert html_wrapper.main_text("<p>a<p>b") == "a\nb" and html_wrapper.main_text("plain") == "plain"
    assert html_wrapper.main_text("<a <a <a") == "<a <a <a"


def test_html_wrapper_finds_the_slot(spark):
    page = '<html><body><div id="top">Site</div><div class="w"><div class="x"><h2>%s</h2><p>%s</p></div></div><div class="z">All rights</div></body></html>'
    pages = [(i, f"http://h.org/{i}", page % (f"Title {i}", f"words {i} " * 9)) for i in range(6)] + [(90, None, None), (91, "http://one.org/", page % ("T", "w"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_host", F.lit("kept")).drop("_host")
    got = {r["page_id"]: r["main_text"] for r in html_wrapper.extract(df).collect()}
    assert got[3] == "Title 3\n" + ("words 3 " * 9).strip() and got[90] == "" and "T\nw" in got[91]
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_html_wrapper_decides_over_all_pages(spark):
    page = '<html><body><div class="bar">%s</div><article><p>%s</p><p>Read more below</p></article><article><p>%s</p></article></body></html>'
    other = '<html><body><div class="bar">%s</div><div class="text"><p>%s</p></div></body></html>'
    pages = [(i, "http://h.org/", page % ("Bar", f"first of {i} " * 5, f"second of {i} " * 5)) for i in range(20)]
    pages += [(100 + i, "http://h.org/", other % ("Bar", f"other of {i} " * 9)) for i in range(6)]
    pages += [(200, "http://one.org/", page % ("Bar", "one", "two"))]
    got = {r["page_id"]: r["main_text"].split("\n") for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # both articles stay, the line that all articles share goes although it is inside an article
    assert got[3] == [("first of 3 " * 5).strip(), ("second of 3 " * 5).strip()]
    assert got[104] == [("other of 4 " * 9).strip()]
    assert got[200] == ["one", "Read more below", "two"]


def test_html_template_is_what_all_pages_repeat(spark):
    page = '<html><body><div class="w"><h2>%s</h2><p>%s</p>%s</div></body></html>'
    note = '<p class="note">Written for the site</p>'
    pages = [(i, "http://h.org/", page % ("Same title" if i < 4 else f"Title {i}", f"words {i} " * 9, note if i % 2 else "")) for i in range(40)]
    got = {r["page_id"]: r["main_text"] for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith("Same title\n") for i in range(4)) and got[9].startswith("Title 9\n")
    assert not any("Written for" in text for text in got.values())  # on half of the pages, but always at its path


def _outline(page):
    return html_wrapper.outlined(html_wrapper.parse(page))[0]


def test_tree_matching_pairs_all_children():
    flat = _outline("<div>" + "<p>1</p><h2>2</h2>" * 150 + "<ul><li>3</ul></div>")
    score, pairs = html_wrapper.tree_matching(flat, flat)
    assert score == 2 * 304 and len(pairs) == 303


def test_tree_matching_pairs_in_order():
    a, b = _outline("<div><p>1</p><h2>2</h2></div>"), _outline("<div><h3>0</h3><p>3</p></div>")
    score, pairs = html_wrapper.tree_matching(a, b)
    assert score == 6 and [(a.labels[x[0]], b.labels[y[0]]) for x, y in pairs] == [("div", "div"), ("p", "p")]
    # containers with other names are partners where their children are, what lies below a lone element keeps its label
    a, b = _outline('<div class="x"><h1>1</h1><p>2</p></div><div class="y">3</div>'), _outline('<div class="z"><h1>1</h1><p>2</p><pre>4</pre></div><div class="q">3</div>')
    assert html_wrapper.places(a, b) == ["html@0", "html@0/div.x@1", "html@0/div.x@1/h#@2", "html@0/div.x@1/p@3", "html@0/div.x@1/pre", "html@0/div.q"]


def test_tree_matching_keeps_the_order_of_long_lists():
    # 520 x 520 pairs that begin and end differently: the last 120 of one come first in the other
    labels = [f"p.{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(520)]
    make = lambda names: html_wrapper.Outline([-1] + [0] * len(names), ["html", *names])
    a, b = make(labels), make(labels[400:] + labels[:400])
    score, pairs = html_wrapper.tree_matching(a, b)
    assert score == 2 * 401 and [(l[0], r[0]) for l, r in pairs] == [(i, i + 120) for i in range(1, 401)]


def _most(a, b, x=0, y=0):
    """Brute force: the best over all ways to leave children out."""
    one, other = a.labels[x], b.labels[y]
    left, right = a.kids(x), b.kids(y)
    if one.split(".")[0] != other.split(".")[0] or one != other and not (left and right):
        return 0
    best = 0
    for n in range(1, min(len(left), len(right)) + 1):
        for ls in itertools.combinations(left, n):
            for rs in itertools.combinations(right, n):
                best = max(best, sum(_most(a, b, p[0], q[0]) for p, q in zip(ls, rs, strict=True)))
    if one != other and best < html_wrapper.ALIKE * (max(a.size(x), b.size(y)) - 1) * 2:
        return 0
    return best + (2 if one == other else 1)


def test_tree_matching_as_brute_force():
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["div", "section"]) + rng.choice(["", ".a", ".b"])
        if not depth or rng.random() < 0.3:
            tag = rng.choice(["p", "h2", "pre", tag])
            return f'<{tag.split(".")[0]} class="{tag.partition(".")[2]}">t</{tag.split(".")[0]}>'
        return f'<{tag.split(".")[0]} class="{tag.partition(".")[2]}">{"".join(tree(depth - 1) for _ in range(rng.randint(1, 3)))}</{tag.split(".")[0]}>'

    for _ in range(150):
        a, b = _outline(tree(2) + tree(3)), _outline(tree(2) + tree(3))
        score, pairs = html_wrapper.tree_matching(a, b)
        assert score == _most(a, b)
        partner = {l[0]: r[0] for l, r in pairs}
        assert len(set(partner.values())) == len(partner)
        assert all(partner.get(a.parents[x], 0) == b.parents[y] for x, y in partner.items())  # parents are paired, too
        assert score == 2 + sum(2 if a.labels[x] == b.labels[y] else 1 for x, y in partner.items())


def test_html_content_by_the_wrapper_alone(spark):
    """No tag, role or name tells the article: the texts come from the alignment, and change when the wrapper is taken away."""
    rng = random.Random(8)
    said = lambda n: " ".join(rng.choice(["oak", "river", "lamp", "stone", "walk", "tree"]) for _ in range(n))
    page = '<html><body><div><p>Home</p><p>Shop</p></div>%s<div><h2>%s</h2>%s<div><p>Written by us</p></div></div><div>%s</div></body></html>'
    rows, wanted = [], {}
    for i in range(60):
        body = [said(40) for _ in range(rng.randint(1, 6))]
        extra = f"<div>{said(4)}</div>" if i % 3 else ""
        title = f"Title {i}"
        rows.append((i, f"http://{'hot' if i < 40 else 'h%d' % (i % 2)}.org/{i}", page % (extra, title, "".join(f"<p>{x}</p>" for x in body), said(3))))
        wanted[i] = "\n".join([title, *body])
    got = {r["page_id"]: r["main_text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == wanted
    assert all(html_wrapper.main_text(html) != wanted[i] for i, _, html in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_html_renamed_articles_keep_their_texts(spark):
    """All pages with their article elements and class names renamed give the texts of before, where the wrapper decides."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(?:article|main)\b", "<$1div"), r'class="[^"]*"', 'class="k"')
    before = {r["page_id"]: r["main_text"] for r in html_wrapper.extract(pages).collect()}
    after = {r["page_id"]: r["main_text"] for r in html_wrapper.extract(pages.withColumn("html", bare)).collect()}
    alone = {r["page_id"]: html_wrapper.main_text(r["html"]) for r in pages.withColumn("html", bare).collect()}
    kept, by_lists = (sum(x[i] == t for i, t in before.items()) for x in (after, alone))
    assert kept >= 0.9 * len(before) and by_lists < 0.5 * len(before), (kept, by_lists, len(before))


@pytest.mark.parametrize("shard", [16_384, 40])
def test_exact_topk_as_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(150)]
    odd = [(1000, None), (1050, [1.0, None] * 3), (1100, [float("nan")] * 6), (1150, []), (1200, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in kdtree.exact_topk(df, F.col("vec_id") % 50 == 0, shard_rows=shard, query_block=4, seed_rows=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    wanted = {i: [(n + 1, j, -s) for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole.items() if j != i)[:5])] for i, v in whole.items() if i % 50 == 0}
    assert {k: sorted(v) for k, v in got.items()} == wanted
    assert kdtree.exact_topk(df.limit(0), F.lit(True)).count() == 0


def _prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {"en": "the of and that with this from have not but what all were when".split(), "de": "der die und das nicht mit ist auf eine für dem werden aus über".split(), "fr": "le la les des est une que dans pour qui sur avec pas vous".split(), "es": "el los las una que con por para como más pero sus este también".split()}


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, _prose(rng, WORDS[lang], rng.randint(4, 40)), lang) for i, lang in enumerate(list(WORDS) * 60)], DOCS + ", lang string")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs, model).where(held).select("lang", "language.lang", "language.score").collect()
    assert np.mean([r[0] == r[1] for r in got]) > 0.97 and all(0 <= r[2] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "é")], DOCS)
    assert [r["l"]["lang"] == "und" for r in langid.identify(odd, model, out_col="l").orderBy("doc_id").collect()] == [True, True, True, False]
    assert langid.LanguageModel().predict("text") == ("und", 0.0)
    assert langid.fit(docs.limit(0)).families == []


def test_language_sample_stays_off_the_driver(spark, monkeypatch):
    docs = spark.range(90).selectExpr("id AS doc_id", "concat(if(id % 2 = 0, 'the quick fox ', 'der flinke fuchs '), id) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    sizes, collect = [], type(docs).collect

    def told(df):
        rows = collect(df)
        sizes.append(sum(len(x) for r in rows for x in r if isinstance(x, bytes | bytearray)))
        return rows

    monkeypatch.setattr(type(docs), "collect", told)
    model = langid.fit(docs)
    assert model.members == [["de", "en"]]
    assert max(sizes) < 90 * 24_000 / 4  # the model of one duel, not the sample's vectors


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    good = lambda: _prose(rng, WORDS["en"], rng.randint(10, 60))
    bad = lambda: " ".join(w + "***" for w in good().split())
    docs = [(i, good() if i % 3 else bad()) for i in range(300)]
    df = spark.createDataFrame(docs + [(900, None), (901, "")], DOCS)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)] + [(900, None)], "doc_id long, quality int")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(df, labels.where(~held))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(df, model).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    out = [r["doc_id"] for r in df.where(held & (F.col("doc_id") < 300)).collect()]
    assert np.mean([(got[i] >= 0.5) == bool(i % 3) for i in out]) > 0.95
    assert quality.fit(df.limit(0), labels.limit(0)).base == 0.5
