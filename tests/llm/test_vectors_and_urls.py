"""Vector operators and the URL filter against brute force, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import ann, multi_index, queries, url_filter
from mercato.llm.url_filter import Rule

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
ODD = [
    (900, None, 1), (901, [0.0] * 8, 1), (902, [1.0] * 7 + [None], 1), (903, [1.0] * 7 + [NAN], 1),
    (904, [1.0] * 7 + [INF], 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1),
    (908, [1e300] * 8, 1), (909, [1e-300] * 8, 1), (910, [1.0] * 8, None), (911, [1.0] * 8, 1),
    (911, [1.0] * 8, 1), (None, [1.0] * 8, 1), (912, [-0.0] * 7 + [1.0], 2), (913, [0.0] * 7 + [3.0], 2),
    (914, [5.0], 3), (915, [7.0], 3),
]


def vectors(seed, n, dims=8, label_count=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.standard_normal(dims) * rng.choice([0.02, 0.08, 0.5])
        rows.append((i, [float(x) for x in v], int(rng.integers(label_count))))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({"n": F.lit("mine"), "component": F.lit(1), "dims": F.lit(0)})


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_cosine(a, b):
    a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def plain_links(rows, threshold):
    links, degree = [], Counter()
    for i, (a, x, k) in enumerate(rows):
        for b, y, m in rows[:i]:
            if k is not None and k == m and a is not None and b is not None and usable(x) \
                    and usable(y) and len(x) == len(y) and plain_cosine(x, y) >= threshold:
                links.append((a, b))
                degree[a] += 1
                degree[b] += 1
    return links, degree


def plain_near_duplicates(rows, threshold):
    links, degree = plain_links(rows, threshold)
    comp = {a: a for a, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(comp[a], comp[b])
            changed |= comp[a] != least or comp[b] != least
            comp[a] = comp[b] = least
    return Counter((a, degree[a] if a is not None else 0, comp[a], a is None or comp[a] == a)
                   for a, _, _ in rows)


@pytest.mark.parametrize("codes,block", [(8, 1024), (4, 7), (1, 5)])
def test_near_duplicate_vectors_equal_brute_force(spark, codes, block):
    rows = vectors(codes, 220) + ODD
    got = multi_index.near_duplicate_vectors(frame(spark, rows), threshold=0.98, codes=codes,
                                             block=block)
    assert Counter(map(tuple, got.collect())) == plain_near_duplicates(rows, 0.98)


def test_near_duplicate_vectors_of_an_empty_table(spark):
    assert multi_index.near_duplicate_vectors(frame(spark, [])).count() == 0


def test_a_third_of_all_rows_may_be_copies(spark):
    rows = vectors(1, 120) + [(1000 + i, [0.5] * 8, 0) for i in range(60)]
    got = multi_index.near_duplicate_vectors(frame(spark, rows), block=8)
    assert Counter(map(tuple, got.collect())) == plain_near_duplicates(rows, 0.98)


def test_traversal_visits_cells_by_growing_bound():
    rng = np.random.default_rng(0)
    one, two = rng.random(9), rng.random(7)
    cells = multi_index.traverse(one, two, 0.9)
    sums = [one[i] + two[j] for i, j in cells]
    assert sums == sorted(sums)
    assert set(cells) == {(i, j) for i in range(9) for j in range(7) if one[i] + two[j] <= 0.9}


def test_region_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((300, 4)), rng.standard_normal((300, 4))
    book = multi_index.Codebook(multi_index.train_codebook(rng.standard_normal((200, 4)), 6))
    _, bound = book.bounds(x)
    code, _ = book.bounds(y)
    gap = ((x[:, None, :] - y[None]) ** 2).sum(axis=2)
    assert (bound[:, code] <= gap + 1e-9).all()


def test_op2_equals_brute_force(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"])
            for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = Counter(map(tuple, queries.op2_embedding_near_dedup(spark, SMALL).collect()))
    assert got == plain_near_duplicates(rows, 0.98)


def plain_nearest(rows, asked, k):
    out = {}
    for q, x, _ in rows:
        if q is None or q not in asked or not usable(x):
            continue
        close = [(-plain_cosine(x, y), c) for c, y, _ in rows
                 if c is not None and c != q and usable(y) and len(x) == len(y)]
        out[q] = sorted(close)[:k]
    return out


@pytest.mark.parametrize("options", [{}, {"query_block": 7, "candidate_block": 5, "tiles": 40}])
def test_nearest_equals_brute_force(spark, options):
    odd = [r for r in ODD if r[0] != 911] + [(911, [1.0] * 8, 1)]
    rows = vectors(5, 200) + odd
    df = frame(spark, rows)
    asked = {i for i in range(0, 200, 9)} | {900, 901, 903, 906, 911, 914}
    got = ann.nearest(df, df.filter(F.col("vec_id").isin(list(asked))), k=5, **options).collect()
    wanted = plain_nearest(rows, asked, 5)
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == {q for q, c in wanted.items() if c}
    for q, found in by_query.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(wanted[q]) + 1))
        assert [s for _, _, s in found] == pytest.approx([-s for s, _ in wanted[q]])
        # equal cosines may differ in the last bit: compare ids where the score is unambiguous
        assert [v for _, v, _ in found] == [c for _, c in wanted[q]] or \
            len({round(s, 12) for s, _ in wanted[q]}) < len(wanted[q])


def test_nearest_breaks_ties_by_id(spark):
    rows = [(i, [1.0, float(i % 3)], 0) for i in range(60)]
    df = frame(spark, rows)
    got = ann.nearest(df, df.filter("vec_id = 30"), k=5, candidate_block=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 3, 6, 9, 12]
    assert ann.nearest(df, df.limit(0)).count() == 0 and ann.nearest(df.limit(0), df).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    for dims in (1, 3, 64, 1500):
        x, y = rng.standard_normal((40, dims)), rng.standard_normal((50, dims))
        close, bound = ann.approximate(ann.Quantised(x), ann.Quantised(y))
        exact = ann.unit(x) @ ann.unit(y).T
        assert (np.abs(close - exact) <= bound).all()


# ---- URLs ---------------------------------------------------------------------------------

RULES = queries.URL_RULES
URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x", "http://www.example.com/en/?q",
    "http://a.www.example.com/en/", "http://example.com/en", "http://example.com", "http://example.com/",
    "http://xexample.com/en/", "http://com/", "http://a.net/es/1#f", "http://net/fr/", "http://a.net/ES/",
    "http://a.net/en/", "x://y://z/es/", "http://a.org#x/y", "http://a.org?u=http://b.com/", "://a.com/en/",
    "http://ünï.com/é", "http://a.com/" + "p/" * 20_000, "http://a.com\n/b",
]


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host))
            and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(4, URLS[4]), (None, URLS[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns(
        {"host": F.lit("mine"), "ratio": F.lit(1), "html": F.lit(None).cast("string")})
    got = url_filter.judge_urls(df, RULES).collect()
    wanted = Counter()
    for i, url in rows:
        host, path, rule = plain_parts(url)
        wanted[(i, host, path, rule.text if rule else None)] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == wanted
    for r in got:
        assert r["verdict"] in ("allow", "block")
        if r["rule"]:
            assert r["verdict"] == {x.text: x.verdict for x in RULES}[r["rule"]]
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0


def plain_ratio(train, text):
    """Witten-Bell interpolation over exact contexts; train: (text, accepted) pairs."""
    logs = []
    for side in (True, False):
        counts = Counter()
        for t, accepted in train:
            if accepted == side:
                data = b"\0" * url_filter.ORDER + t.encode() + b"\1"
                for i in range(url_filter.ORDER, len(data)):
                    for o in range(url_filter.ORDER + 1):
                        counts[(o, data[i - o:i], data[i])] += 1
        total, kinds = Counter(), Counter()
        for (o, context, _), n in counts.items():
            total[(o, context)] += n
            kinds[(o, context)] += 1
        data, log = b"\0" * url_filter.ORDER + text.encode() + b"\1", 0
        for i in range(url_filter.ORDER, len(data)):
            chance = 1 / 256
            for o in range(url_filter.ORDER + 1):
                key = (o, data[i - o:i])
                if total[key]:
                    chance = (counts[(*key, data[i])] + kinds[key] * chance) / (total[key] + kinds[key])
            log += math.log(chance)
        logs.append(log / (len(text.encode()) + 1))
    return logs[0] - logs[1]


def test_model_equals_exact_counts(spark):
    rng = random.Random(4)
    train = [("".join(rng.choice("abc/.") for _ in range(rng.randrange(1, 12))), bool(i % 2))
             for i in range(60)]
    counts = url_filter.count_bins(spark.createDataFrame(train, "text string, accepted boolean"))
    model = url_filter.load_model(counts)
    texts = [t for t, _ in train[:20]] + ["", "zzz", "é"]
    got = url_filter.log_ratio(model, [t.encode() for t in texts])
    assert np.allclose(got, [plain_ratio(train, t) for t in texts], rtol=0, atol=1e-9)


def test_counts_stay_exact_with_many_ngrams(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    train = [("".join(rng.choice(letters) for _ in range(40)), bool(i % 2)) for i in range(4000)]
    counts = url_filter.count_bins(spark.createDataFrame(train, "text string, accepted boolean"))
    texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(3)]
    got = url_filter.log_ratio(url_filter.load_model(counts), [t.encode() for t in texts])
    assert np.allclose(got, [plain_ratio(train, t) for t in texts], rtol=0, atol=1e-6)


def test_method_judges_unmarked_urls(spark):
    rng = random.Random(6)
    rules = [Rule("good", "/", "allow"), Rule("bad", "/", "block")]

    def url(host, words):
        return f"http://{host}/" + "-".join(rng.choice(words) for _ in range(4))

    fine, spam = ["news", "science", "garden"], ["casino", "bets", "winner"]
    rows = [url("good", fine) for _ in range(200)] + [url("bad", spam) for _ in range(200)]
    judged = [url("other", fine) for _ in range(30)] + [url("other", spam) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(rows + judged)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, rules).collect()}
    assert [got[400 + i] for i in range(60)] == ["allow"] * 30 + ["block"] * 30


def test_models_read_the_whole_url(spark):
    rng = random.Random(8)
    rules = [Rule("good", "/", "allow"), Rule("bad", "/", "block")]
    fine, spam = ["news", "science", "garden"], ["casino", "bets", "winner"]

    def words(of):
        return "-".join(rng.choice(of) for _ in range(4))

    def number():
        return rng.randrange(10_000)

    urls = [f"http://good/{number()}?{words(fine)}" for _ in range(200)] \
        + [f"http://bad/{number()}?{words(spam)}" for _ in range(200)]
    for mark in "?#":
        urls += [f"http://other/1{mark}{words(fine)}" for _ in range(10)]
        urls += [f"http://other/1{mark}{words(spam)}" for _ in range(10)]
    urls += [words(fine) for _ in range(10)] + [words(spam) for _ in range(10)]     # no ://
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules).collect()}
    assert [got[400 + i]["verdict"] for i in range(40)] == (["allow"] * 10 + ["block"] * 10) * 2
    assert all(got[440 + i]["ratio"] > 0 > got[450 + i]["ratio"] for i in range(10))
    assert [got[440 + i]["verdict"] for i in range(20)] == ["allow"] * 10 + ["block"] * 10


def plain_verdicts(urls, rules):
    """(ratio, verdict) of every URL: counts of all marked URLs, and the threshold in the middle of
    the best gap over the fold, scored with the counts of the others."""
    parts = []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else url or ""
        host, path, _ = plain_parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        parts.append((rest, rule, zlib.crc32((host + path).encode()) % url_filter.FOLD == 0))
    marked = [(t, r.verdict == "allow", fold) for t, r, fold in parts if r]
    fit = [(t, good) for t, good, fold in marked if not fold]
    held = [(math.floor(plain_ratio(fit, t) * 64), good) for t, good, fold in marked if fold]
    n_good = sum(good for _, good in held)
    wrong = {cut: sum(1 / n_good for b, good in held if good and b < cut)
             + sum(1 / (len(held) - n_good) for b, good in held if not good and b >= cut) for cut in range(-640, 642)}
    least = min(wrong.values())
    cuts = [cut for cut, w in wrong.items() if w < least + 1e-9]
    limit = (min(cuts) + max(cuts)) / 2 / 64
    out = []
    for text, rule, _ in parts:
        ratio = plain_ratio([(t, good) for t, good, _ in marked], text)
        out.append((ratio, rule.verdict if rule else "allow" if ratio >= limit else "block"))
    return out


def test_verdicts_equal_plain_counts(spark):
    rng = random.Random(11)
    rules = [Rule("good", "/", "allow"), Rule("bad", "/", "block")]
    fine, spam = ["news", "science", "garden", "deal"], ["casino", "bets", "winner", "deal"]

    def words(of):
        return "-".join(rng.choice(of) for _ in range(3))

    urls = [f"http://good/{words(fine)}" for _ in range(60)] + [f"http://bad/{words(spam)}" for _ in range(60)]
    urls += [f"http://other/{words(fine + spam)}" for _ in range(25)] + [words(fine + spam) for _ in range(25)]
    urls += ["casino-7", "news", "", None, "http://", "no scheme"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules).collect()}
    for i, (ratio, verdict) in enumerate(plain_verdicts(urls, rules)):
        assert got[i]["ratio"] == pytest.approx(ratio, abs=1e-9), urls[i]
        assert got[i]["verdict"] == verdict, (urls[i], ratio)
    assert got[170]["verdict"] == "block"


def test_many_tied_vectors_are_computed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 64)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(60)] + [(100 + i, [1.0, float(i), 0.5], 0) for i in range(20)]
    heaps = ann.Heaps(np.arange(60), np.array([r[1] for r in rows[:60]]), 5)
    heaps.offer(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    heaps.offer(np.array([7, 3]), np.array([[1.0, 2.0, 3.0]] * 2) + 200)
    for i in range(60):
        assert heaps.found[i].tolist() == [j for j in range(60) if j != i][:5]


def test_marked_urls_of_the_fold_are_counted(spark):
    rules = [Rule("good", "/", "allow"), Rule("bad", "/", "block")]
    urls = [f"http://{host}/{word}/{i}" for i in range(40)
            for host, word in (("good", "news"), ("bad", "bets"))] + ["http://other/1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["ratio"] for r in url_filter.judge_urls(df, rules).collect()}
    train = [(u[7:], "good" in u) for u in urls[:80]]
    assert got[0] == pytest.approx(plain_ratio(train, urls[0][7:]), abs=1e-9)
    assert got[80] == pytest.approx(plain_ratio(train, "other/1"), abs=1e-9)


def test_op9_judges_every_page(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op9_url_filter(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule = plain_parts(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
