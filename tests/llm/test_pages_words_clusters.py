"""Main text, spelling variants and centroid clusters against planted pages and brute force, with
odd rows."""

import hashlib
import html
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import heap_kmeans, html_extract, spelling

WORDS = "river, stone bridge over & under <old> town walls, market über café \"quoted\" 5 < 6".split(" ")
AROUND = [
    '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">News today</a></li></ul></nav>',
    "<header><h2>Site name</h2><p>The best site, of all, in town, ever made.</p></header>",
    '<div class="menu-main"><a href="/x">one</a> <a href="/y">two</a> <a href="/z">three</a></div>',
    '<aside><p>Read this sidebar, it is long, and full of commas, indeed.</p></aside>',
    '<div id="sidebar-left"><p>Another sidebar, with, many, commas, in, it, all, of, them.</p></div>',
    '<div class="cookie-notice"><p>We use cookies, and more cookies, to make this site work.</p></div>',
    '<div class="ad">Buy this, buy that, buy it all, today, only here.</div>',
    '<section class="adBanner"><p>Buy this, buy that, buy it all, today.</p></section>',
    '<form action="/s"><label>Search the site</label><input name=q><p>Search here, or there.</p></form>',
    '<section id="comments"><article class="comment"><p>First, I, think, this, is, great, really.'
    "</p></article><article><p>Me, too, I, also, think, this, is, great.</p></article></section>",
    '<div class="reader-comments"><p>I, disagree, with, all, of, this, text.</p></div>',
    '<footer><p>&copy; Site, all rights reserved, for ever, and a day.</p></footer>',
    "<script>document.write('<p>no, text, here</p>');</script>", "<style>p > b { margin: 0 }</style>",
    "<!-- <p>a, comment, that, is, long</p> -->", '<div style="display: none">unseen, text, here</div>',
    '<noscript><p>Switch on, please, your scripts, all of them.</p></noscript>',
]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def planted(rng):
    """A page and its main text: blocks in one of several wrappings, other parts around and between."""
    texts = [words(rng, rng.choice([1, 3, 30, 120])) for _ in range(rng.randint(3, 9))]
    title = words(rng, 4)
    blocks = []
    for t in texts:
        body = html.escape(t)
        if rng.random() < 0.3:
            first, _, rest = body.partition(" ")
            body = f'<b>{first}</b> <a href="/q?a=1&amp;b=2" title="x > y">{rest}</a>' if len(body) < 40 \
                else f"<em>{first}</em> {rest}"
        blocks.append(rng.choice([f"<p>{body}</p>", f"<p>{body}", f"<P CLASS=x>\n {body}\n</P>",
                                  f"<blockquote>{body}</blockquote>"]))
    for part in rng.sample(AROUND, 4):
        blocks.insert(rng.randint(0, len(blocks)), part)
    head = f"<h1>{html.escape(title)}</h1>"
    inner = "".join(blocks)
    article = rng.choice([
        f"<article>{head}{inner}</article>", f'<main role="main">{head}{inner}</main>',
        f'<div class="page-wrap"><div class="article-body">{head}{inner}</div></div>',
        f"<article><header>{head}</header><section>{inner}</section></article>",
        f'<div id="content"><div class="x1">{head}{inner}</div></div>'])
    before, after = rng.sample(AROUND, 4), rng.sample(AROUND, 5)
    page = ("<!DOCTYPE html><html><head><title>A, title, of, it, all</title></head><body class='has-sidebar'>"
            + "".join(before) + article + "".join(after) + rng.choice(["</body></html>", ""]))
    return page, " ".join(" ".join([title, *texts]).split())


def test_planted_pages(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(300):
        page, text = planted(rng)
        rows.append((i, f"https://h/{i}", page))
        want[i] = text
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"text": F.lit("mine"), "n_chars": F.lit(0)})
    got = {r.page_id: r for r in html_extract.extract_main_text(df).collect()}
    wrong = [i for i in want if got[i].text != want[i]]
    assert not wrong, (rows[wrong[0]][2], got[wrong[0]].text, want[wrong[0]])
    assert all(got[i].n_chars == len(want[i]) and got[i].url == f"https://h/{i}" for i in want)


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"),
    ("<p>1 < 2 &lt; 3 &#x41;&#66;&nbsp;&eacute; &amp;lt; &bogus; &am", "1 < 2 < 3 AB é &lt; &bogus; &am"),
    ("<p>x&#99999999999999999999999;y&#" + "9" * 5000 + ";z</p>", "x�y�z"),
    ("<article><h1></h1></article><div class='ad'>Buy, buy, buy.</div>", ""),
    ("<ul><li><a href=/1>one</a><li><a href=/2>two</a><li><a href=/3>three</a></ul>", ""),
    ("<p>one<br>two<br/>three<b>four</b></p>", "one two threefour"),
    ("<title>t</title><p>kept</p><script>if (a < b) '</p>'", "kept"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p>cut <a href='x", "cut"),
    ("<div><p>x</div></div></div><p>y</p></b></i>", "x y"), ("<!---><p>z</p><!-- open", "z"),
    ("<div class='content'>direct text,<br>no paragraphs</div>", "direct text, no paragraphs"),
    ("<form id=all><main><p>inside a page-wide form</p></main></form>", "inside a page-wide form"),
    ("<body><h1>Head</h1><div class=t>" + "<p>Some text, of the first part.</p>" * 9 + "</div>"
     "<div class=t><p>short</p></div></body>", "Head " + "Some text, of the first part. " * 9 + "short"),
])
def test_odd_pages(source, text):
    assert html_extract.main_text(source) == text


def test_long_and_deep_pages_cost_linear_time():
    many = 60_000
    assert html_extract.main_text("<article>" + "<p>a, b</p>" * many) == " ".join(["a, b"] * many)
    for opening in ("<div>", "<b>", "<i><b>", "<li>", "<a href=x>", "<ul><li>", "<p><b>", '<a b="', "<x ="):
        html_extract.main_text(opening * many + "text" + "</i>" * many + "</div>" * many)


def test_page_rows_that_repeat_or_lack_values(spark):
    rows = [(None, None, "<p>a"), (2 ** 60 + 1, "u", None), (7, "u", "<p>b"), (7, "u", "<p>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, html_extract.extract_main_text(df).collect()), key=str)
    assert got == sorted([(None, None, "a", 1), (2 ** 60 + 1, "u", "", 0), (7, "u", "b", 1),
                          (7, "u", "b", 1)], key=str)
    empty = html_extract.extract_main_text(df.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


# ---- spelling variants ----

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(counts, min_chars, min_count, ratio):
    kept = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in kept if one_edit(w, v)] for w in kept}
    forms = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-kept[v], v), default=None)
        forms[w] = best if best is not None and kept[best] >= ratio * kept[w] else None
    out = {}
    for w in kept:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (w, forms[w], root, kept[w], len(near[w]), kept[forms[w]] if forms[w] else None)
    return out


def test_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(150)]
    for w in list(base):
        i = rng.randrange(len(w))
        base += [w[:i] + w[i + 1:], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1:], w + "b", "b" + w, w * 2,
                 w * 2 + "a"]
    counts = {w: rng.choice([1, 2, 5, 9, 30, 200, 1500, 1500]) for w in base}
    df = spark.createDataFrame(list(counts.items()) + [(None, 9)], "word string, n long")
    for min_chars, min_count, ratio in ((4, 2, 5), (6, 5, 5), (5, 1, 1000)):
        got = spelling.spelling_variants(df.withColumn("form", F.lit("x")), min_chars, min_count, ratio).collect()
        assert {r.word: tuple(r) for r in got} == plain_variants(counts, min_chars, min_count, ratio)
        assert len(got) == len({r.word for r in got})
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, min_chars=3)


def test_long_chains_reach_their_root(spark):
    words_ = ["abcdef" + "g" * i for i in range(12)]
    df = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(words_)], "word string, n long")
    got = {r.word: r for r in spelling.spelling_variants(df).collect()}
    assert all(got[w].root == words_[-1] for w in words_)
    assert [got[w].form for w in words_] == [*words_[1:], None]


def test_counted_words(spark):
    rng = random.Random(9)
    texts = [None, "", "123 ...", "Straße STRASSE Été été x×y", "a " * 5000 + "b" * 20000]
    texts += [" ".join(rng.choice(["Alpha", "beta1gamma", "delta-epsilon", "cafÉs", "zz"]) for _ in range(200))
              for _ in range(40)]
    docs = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(12, "Alpha again"), (12, "Alpha again")]
    for slip in (None, 1, 3):
        want = Counter()
        for d, t in docs:
            run = ""
            for c in (t or "") + " ":
                if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                    run += c.lower() if c.isascii() else c
                    continue
                if run and slip is not None:
                    h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                    if h % slip == 0:
                        run = run[:h % len(run)] + run[h % len(run) + 1:]
                if run:
                    want[run] += 1
                run = ""
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("mine"))
        assert {r.word: r.n for r in spelling.count_words(df, slip).collect()} == want


# ---- centroid clustering ----

def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e15 else 64 * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), raw) for (i, _), raw in
                    zip(kept, [v for i, v in rows if v is not None and len(v) == dims
                               and all(x is not None and math.isfinite(x) for x in v)]) if i is not None)
    centroids = [[math.floor(64 * x) if abs(x) < 1e15 else 64 * int(x) for x in v] for _, v in starts[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
                for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    total = sum(inertia.values())

    def fit(x):
        return x if x < 2 ** 63 else None
    return sorted([(i, c, fit(d), fit(inertia[c]), fit(total),
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, found)], key=str)


def cluster_rows(seed, n, dims, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims))
    return [(i, [float(x) * scale for x in centres[rng.integers(5)] + 0.3 * rng.standard_normal(dims)])
            for i in range(n)]


@pytest.mark.parametrize("seed, n, scale, rounds", [(1, 2500, 1.0, 3), (2, 700, 0.02, 6), (3, 300, 3e5, 4),
                                                    (4, 120, 1e30, 3), (5, 60, 1e306, 2)])
def test_clusters_equal_plain_rounds(spark, seed, n, scale, rounds):
    rows = cluster_rows(seed, n, 8, scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = heap_kmeans.cluster_vectors(df.withColumn("cluster", F.lit(0)), k=7, rounds=rounds, dims=8)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, 7, rounds, 8)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = cluster_rows(6, 200, 4) + [
        (1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0] * 5), (1004, [1.0, None, 1.0, 1.0]),
        (1005, [nan] * 4), (1006, [inf] * 4), (1007, [0.0] * 4), (1008, [-0.0, -1e-320, 5e-324, 0.0]),
        (None, [1.0] * 4), (None, [1.0] * 4), (1009, [2.0] * 4), (1009, [2.0] * 4), (1009, [3.0] * 4),
        (2 ** 60 + 1, [1e18] * 4), (1010, [-1e12, 7.3, 0.1, 2.0 ** 60])] + [(2000 + i, [0.5] * 4) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for k in (1, 4, 30):
        got = heap_kmeans.cluster_vectors(df, k=k, rounds=3, dims=4)
        assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, k, 3, 4)
    few = heap_kmeans.cluster_vectors(df.filter("vec_id IN (1007, 1009)"), k=16, rounds=3, dims=4)
    assert sorted(map(tuple, few.collect()), key=str) == plain_clusters(
        [r for r in rows if r[0] in (1007, 1009)], 16, 3, 4)
    for none in (df.limit(0), df.filter("vec_id IS NULL")):
        got = heap_kmeans.cluster_vectors(none, k=4, dims=4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert got.count() == 0


def test_most_vectors_are_left_alone():
    """The heaps spare the vectors whose gap has not expired."""
    rng = np.random.default_rng(1)
    centres = [[100 * j, -100 * j] for j in range(5)]
    x = np.array([centres[j % 5] for j in range(500)]) + rng.integers(-20, 20, (500, 2))
    block = heap_kmeans.Block(x, 5, np.full(500, -1), np.zeros(500), [[] for _ in range(5)])
    block.scan(np.arange(500), centres, [0.0] * 5)
    moved = [[c[0] + 1, c[1]] for c in centres]
    drift = heap_kmeans._drift(centres, moved, [0.0] * 5)
    assert len(block.expired(drift)) < 25
