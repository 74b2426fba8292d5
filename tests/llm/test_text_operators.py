"""Operators on texts against brute force, on a fixture with nulls, empty and long texts, repeated
rows and clashing columns, and on the given documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mercato.llm import binary_ids, components, line_dedup, minhash, mixing, packing, pii, queries, toxicity
from mercato.llm.common import by_bytes
from mercato.llm.components import connected_components
from mercato.llm.perfect_hash import PerfectHash, Shard
from mercato.llm.shingles import shingle_sets
from mercato.llm.tokens import WORD_BPE, Encoder, encoder

SMALL = "/root/testdata/sf0.001"
SHARED = "This line is shared by many documents."
LONG = "lorem ipsum dolor " * 6000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\n" + SHARED, "en", "a"),
    (2, "  this LINE is shared by many documents.\t\nother text", "en", "a"),
    (3, SHARED + "\n" + SHARED + "\nshort", None, "b"),
    (4, None, "en", "b"),
    (5, "", "de", None),
    (6, " \t\n\x0b ", "de", None),
    (7, LONG, "en", "a"),
    (7, LONG, "en", "a"),
    (8, "x" * 30_000, "en", "c"),
    (9, "Éàü ß 中文 😀 ΑΒΣ İ <|endoftext|> <|ENDOFTEXT|> it's 12³", "fr", "c"),
    (None, SHARED, "en", "a"),
    (10, "one\n\n\ntwo\r\n", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def clashing(docs, *names):
    return docs.withColumns({n: F.lit("mine") for n in names}).withColumn("tags", F.array(F.lit(1)))


# ---- tokens -------------------------------------------------------------------------------

def library_ids(text):
    return encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library_on_odd_strings():
    rng = random.Random(5)
    chars = "abCé ÉßİΣσς ǅŉ²½٣1 2'sS'T'LL_-.,<|>\n\t\x0b\x0c\x1c\x85\xa0 ̱́Hhªʰ中😀"
    for _ in range(4000):
        s = "".join(rng.choice(chars) for _ in range(rng.randint(0, 14)))
        s += rng.choice(["", "", "", "<|endoftext|>x", "<|ENDOFTEXT|>"])
        assert np.frombuffer(encoder().encode(s), "<u4").tolist() == library_ids(s), repr(s)


def test_encoder_cache_stays_bounded():
    small = Encoder(encoder_path(), cached_words=50)
    for i in range(400):
        text = f"word{i} other{i % 7}"
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library_ids(text)
    assert len(small.lowered) <= 51 and len(small.lowered.old) <= 51


def encoder_path():
    import public_tokenizers
    return str(public_tokenizers.path(WORD_BPE))


# ---- 7: binary ids ------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    planes = binary_ids.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert binary_ids.from_planes(planes, n, bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 64, 200, 0, 3]
    ids = [rng.integers(0, 50_000, n).astype("<u4") for n in sizes]
    writer = binary_ids.FileWriter(block=64, bits=bits)
    for i, x in enumerate(ids):
        writer.add(None if i == 0 else i, x.tobytes())
    back = list(binary_ids.read_documents(writer.close()))
    assert [d for d, _, _ in back] == [None, 1, 2, 3, 4, 5, 6]
    assert [s for _, s, _ in back] == (np.cumsum(sizes) - sizes).tolist()
    assert all(a.tolist() == b.tolist() for (_, _, a), b in zip(back, ids))


def expected_ids(rows, end_id):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library_ids(text) + [end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_hold_every_document(spark, docs, planes):
    written = binary_ids.write_token_files(docs, planes=planes, block=512, file_chars=40_000)
    assert written.files.count() > 1
    rows = binary_ids.read_token_files(spark, written).collect()
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows),
                 key=lambda r: r[1])
    assert got == expected_ids(texts_of(docs), 2)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_op7_equals_brute_force(spark, given):
    rows = queries.op7_binary_ids(spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == expected_ids(texts_of(given), 2)


def test_token_files_of_an_empty_table(spark, docs):
    written = binary_ids.write_token_files(docs.limit(0))
    assert binary_ids.read_token_files(spark, written).count() == 0


# ---- 10: packing --------------------------------------------------------------------------

def plain_best_fit(lengths, size):
    rooms = []
    for need in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= need]
        if fits:
            best = min(fits, key=lambda i: rooms[i])
            rooms[best] -= need
        else:
            rooms.append(size - need)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 100))
    lengths = rng.integers(1, size + 1, 300)
    bins, offsets = packing.best_fit_decreasing(lengths, size)
    used = np.bincount(bins, lengths)
    assert sorted((size - used).tolist()) == plain_best_fit(lengths.tolist(), size)
    check_gapless(zip(bins.tolist(), offsets.tolist(), lengths.tolist()), size)


def check_gapless(places, size):
    by_bin = defaultdict(list)
    for b, offset, length in places:
        by_bin[b].append((offset, length))
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size


def check_packing(rows, source, size, end_id):
    wanted = Counter()
    for doc_id, text in source:
        ids = np.array(library_ids(text) + [end_id], "<u4")
        for piece, at in enumerate(range(0, len(ids), size)):
            part = ids[at:at + size]
            wanted[(doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                   for r in rows) == wanted
    check_gapless(((r["sequence_id"], r["offset"], r["length"]) for r in rows), size)


def test_packing_of_odd_rows(docs):
    rows = packing.pack_documents(docs, size=64, group_pieces=100, with_ids=True).collect()
    check_packing(rows, texts_of(docs), 64, 1)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_op10_packs_tightly(spark, given):
    rows = queries.op10_best_fit_packing(spark, SMALL).collect()
    check_packing(rows, texts_of(given), 4096, 1)
    sequences = len({r["sequence_id"] for r in rows})
    short = [r["length"] for r in rows if r["length"] < 4096]
    assert sequences == len(rows) - len(short) + len(plain_best_fit(short, 4096))


# ---- 8: line dedup ------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    made = PerfectHash.build(keys)
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))


def test_shard_rejects_foreign_keys_and_keeps_twins():
    keys, prints = np.array([5, 5, 9, -3]), np.array([1, 2, 1, 7])
    shard = Shard.from_bytes(Shard.build(keys, prints, np.array([3, 4, 5, 6]),
                                         np.array([30, 40, 50, 60])).to_bytes())
    count, last = shard.find(np.array([5, 5, 5, 9, -3, 8]), np.array([1, 2, 3, 1, 7, 1]))
    assert count.tolist() == [3, 4, 0, 5, 6, 0] and last.tolist() == [30, 40, 0, 50, 60, 0]


def plain_line_dedup(rows, min_chars=20, min_docs=3):
    white = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(white))

    holders = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-(1 << 63) if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs
                or max(holders[key(x)]) == own]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("shard_keys", [1, 1 << 20])
def test_line_dedup_equals_brute_force(docs, shard_keys):
    got = line_dedup.dedup_lines(clashing(docs, "n_lines"), shard_keys=shard_keys)
    assert got.columns[-2:] == ["n_lines", "n_dropped"] and got.schema["tags"] is not None
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in rows) \
        == Counter(plain_line_dedup(texts_of(docs)))
    assert sum(r["n_dropped"] for r in rows) == 3
    assert all(r["n_chars"] == len(r["text"]) and r["tags"] == [1] for r in rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_every_shard_is_read_once(tmp_path, monkeypatch):
    """Twenty shards, hashes of many documents: one read of each."""
    rng = np.random.default_rng(3)
    keys = rng.integers(-2 ** 62, 2 ** 62, (5000, 2))
    reads = Counter()
    for shard in range(20):
        own = keys[np.mod(keys[:, 0], 20) == shard]
        made = line_dedup.Shard.build(own[:, 0], own[:, 1], np.full(len(own), 3), np.arange(len(own)))
        line_dedup.write_file(f"{tmp_path}/shard-{shard}.npz", made.to_bytes())
    whole = line_dedup.read_file

    def counted(name):
        reads[name] += 1
        return whole(name)

    monkeypatch.setattr(line_dedup, "read_file", counted)
    asked = np.concatenate([keys, keys[::2], rng.integers(-2 ** 62, 2 ** 62, (500, 2))])
    found, _ = line_dedup.look_up(str(tmp_path), 20, np.ascontiguousarray(asked), 3)
    assert len(found) == 5000 and set(reads.values()) == {1} and len(reads) == 20
    assert {tuple(x) for x in found.tolist()} == {tuple(x) for x in keys.tolist()}


def test_line_dedup_counts_code_points(spark):
    rows = [(i, t) for i in range(4) for t in ["é" * 19, "é" * 20, "中" * 7]]
    rows = [(10 * i + j, t) for j, (i, t) in enumerate(rows)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) \
        == Counter(plain_line_dedup(rows))


def test_op8_equals_brute_force(spark, given):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"])
           for r in queries.op8_line_dedup(spark, SMALL).collect()}
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest())
                   for d, t, n, k in plain_line_dedup(texts_of(given))}


# ---- 6: near-duplicates -------------------------------------------------------------------

def word_shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def plain_components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_near_duplicates(rows, width, percent):
    sets = [(d, word_shingles(t, width)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
             if a is not None and b is not None and x and y
             and 100 * len(x & y) >= percent * len(x | y)]
    comp = plain_components({d for d, _ in rows if d is not None}, links)
    return Counter((d, len(s), comp.get(d), d is None or comp[d] == d) for d, s in sets)


def near_copies(seed, families, copies, words):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + words // 25)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = near_copies(width, 25, 12, 60) + [(1000 + i, "a b " * i) for i in range(8)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"),
                                  width=width, percent=percent, block=4)
    assert Counter(map(tuple, got.collect())) == plain_near_duplicates(rows, width, percent)


def test_near_duplicates_of_odd_rows(docs):
    got = minhash.near_duplicates(clashing(docs, "component", "node"))
    assert Counter(map(tuple, got.collect())) == plain_near_duplicates(texts_of(docs), 5, 80)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    left = [r["doc_id"] for r in minhash.drop_near_duplicates(docs).collect()]
    assert Counter(left) == Counter([None, *range(1, 11)])


def test_op6_equals_brute_force(spark, given):
    got = Counter(map(tuple, queries.op6_minhash_near_dedup(spark, SMALL).collect()))
    assert got == plain_near_duplicates(texts_of(given), 3, 85)


def test_shingle_sets_count_distinct_shingles():
    texts = [t or "" for _, t, _, _ in ROWS] + ["A a A a a", "x\x0by\x0cz\rw"]
    for width in (1, 3, 5):
        sets = shingle_sets([t.encode() for t in texts], width)
        assert sets.sizes.tolist() == [len(word_shingles(t, width)) for t in texts]


def test_match_threshold_bounds_the_miss_rate():
    t = minhash.match_threshold(64, 0.85, 1e-7)
    draws = np.random.default_rng(0).binomial(64, 0.85, 200_000)
    assert 30 < t < 45 and (draws < t).sum() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] \
        + [(100 + i, 101 + i) for i in range(20)] + [(200, 200)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got.collect()} \
        == plain_components(nodes, [p for p in links if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, step = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or step(edges))
    links = [(i, i + 1) for i in range(3_000) if i % 1_000 != 999]
    random.Random(5).shuffle(links)
    monkeypatch.setattr(components, "CHUNK_LINKS", 100, raising=False)
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: i // 1_000 * 1_000 for i in range(3_000)}
    del rounds[:]
    monkeypatch.undo()
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or step(edges))
    assert connected_components(spark.createDataFrame(links, "a long, b long").coalesce(1)).count() == 3_000
    assert not rounds  # one chunk needs no shuffled round


# ---- 4: toxicity --------------------------------------------------------------------------

def test_gradients_match_differences():
    texts = [b"you are a loser and idiot " * 12, b"the cat sat on the mat", b"", b"hello you " * 20]
    label = np.array([1, 0, 0, 1], bool)
    words = toxicity.Words(texts)
    index, text = words.windows()
    p = toxicity.initial_parameters()
    facts = toxicity.Seen(texts * 4, np.tile(label.astype(int), 4)).facts(words)
    assert facts[0].min() > 0 and facts[1].any()
    _, g = toxicity.gradients(p, words, facts, index, text, label)
    for name, value in p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        old, step = value[at], 1e-2
        sides = []
        for change in (step, -step):
            value[at] = old + change
            sides.append(toxicity.gradients(p, words, facts, index, text, label)[0])
        value[at] = old
        assert g[name][at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=0.05, abs=1e-4)


def test_windows_cover_every_word():
    texts = [b"", b"a", b"a " * 32, b"a " * 33, b"a " * 48, b"a " * 1000]
    words = toxicity.Words(texts)
    index, text = words.windows()
    assert words.counts.tolist() == [0, 1, 32, 33, 48, 1000]
    assert set(index[index >= 0].tolist()) == set(range(sum(words.counts)))
    assert np.bincount(text).tolist() == [1, 1, 1, 2, 2, 62]


def folded_words(text):
    return [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", text.lower()) if w]


def word_pieces(word):
    padded = b" " + word + b" "
    return [padded[i:i + toxicity.PIECE] for i in range(len(padded) - toxicity.PIECE + 1)]


TOXIC_TEXTS = [b"You are a LOSER, an idiot", b"the cat sat on the mat", b"", b"idiots! loser?", b"caf\xc3\xa9 cat x",
               b"moronically idiotic", b"the idiot", b"a loser and a cat", b"mat mat mat"] * 4
TOXIC_LABELS = np.array([1, 0, 0, 1, 0, 1, 1, 1, 0] * 4)


def plain_facts(word, texts, labels):
    """Share and evidence of a word from plain counts over sets of texts."""
    n = [int((labels == c).sum()) for c in (0, 1)]
    share = [toxicity.PRIOR * x / sum(n) for x in n]

    def seen(has):
        return [sum(has(t) for t, y in zip(texts, labels) if y == c) for c in (0, 1)]

    def evidence(counts):
        a, b = (c + s for c, s in zip(counts, share))
        odds = np.log(b / a) - np.log(share[1] / share[0])
        return np.sign(odds) * max(0, abs(odds) - toxicity.ERRORS * np.sqrt(1 / a + 1 / b))

    own = seen(lambda t: word in folded_words(t))
    parts = [evidence(seen(lambda t: any(q in word_pieces(w) for w in folded_words(t)))) for q in word_pieces(word)]
    return sum(own) / (sum(own) + toxicity.SHRINK), [evidence(own), max([0, *parts]), min([0, *parts])]


def test_words_seen_equal_plain_counts():
    asked = [b"a loser, the idiot", b"", b"unseen moronic cat"]
    keeps, evidence = toxicity.Seen(TOXIC_TEXTS, TOXIC_LABELS, step=2).facts(toxicity.Words(asked))
    plain = [plain_facts(w, TOXIC_TEXTS, TOXIC_LABELS) for t in asked for w in folded_words(t)]
    assert keeps == pytest.approx([k for k, _ in plain], abs=1e-5)
    assert evidence == pytest.approx(np.array([e for _, e in plain]), abs=1e-4)
    assert evidence[1, 0] > 0 and keeps[4] == 0 and not evidence[4].any()     # 'loser', 'unseen'


def test_training_texts_do_not_vouch_for_themselves():
    texts, labels = [*TOXIC_TEXTS, b"once"], np.append(TOXIC_LABELS, 1)
    words = toxicity.Words(texts)
    keeps, evidence = toxicity.Seen(texts, labels).facts(words, labels.astype(bool))
    at = 0
    for i, t in enumerate(texts):
        rest = [x for j, x in enumerate(texts) if j != i]
        for w in folded_words(t):
            counts = sum(w in folded_words(x) for x in rest)
            assert keeps[at] == pytest.approx(counts / (counts + toxicity.SHRINK), abs=1e-5)
            if counts == 0:
                assert evidence[at, 0] == 0
            at += 1
    assert at == len(keeps)


def plain_window_logit(p, rows):
    """One window, one step at a time."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    n = toxicity.HIDDEN
    states = []
    for side, order in (("f", rows), ("r", rows[::-1])):
        h, own = np.zeros(n), []
        for x in order:
            gx, gh = x @ p["Wx" + side] + p["bx" + side], h @ p["Wh" + side]
            r, z = sigmoid(gx[:n] + gh[:n]), sigmoid(gx[n:2 * n] + gh[n:2 * n])
            new = np.tanh(gx[2 * n:] + r * gh[2 * n:])
            h = (1 - z) * new + z * h
            own.append(h)
        states.append(own if side == "f" else own[::-1])
    if not rows:
        return p["b"][0]
    both = [np.concatenate(pair) for pair in zip(*states)]
    weight = np.exp([np.tanh(s @ p["Wa"] + p["ba"]) @ p["va"] for s in both])
    return sum(w * s for w, s in zip(weight / weight.sum(), both)) @ p["w"] + p["b"][0]


def test_scores_equal_a_plain_loop():
    rng = random.Random(5)
    pool = [w.decode("utf-8") for t in TOXIC_TEXTS for w in folded_words(t)] + ["new", "losers"]
    asked = [" ".join(rng.choice(pool) for _ in range(n)).encode() for n in (0, 1, 31, 32, 33, 48, 49, 100)]
    p = toxicity.initial_parameters(3)
    seen = toxicity.Seen(TOXIC_TEXTS, TOXIC_LABELS)
    got = toxicity.score_texts(p, seen, asked)
    for text, score in zip(asked, got):
        words = folded_words(text)
        inputs = []
        for w in words:
            one = toxicity.Words([w])
            keep, evidence = plain_facts(w, TOXIC_TEXTS, TOXIC_LABELS)
            keep *= 1 - toxicity.DROP
            inputs.append(np.concatenate([p["word"][one.buckets[0]] * keep,
                                          p["char"][one.trigrams].mean(axis=0) * keep, evidence]))
        windows, start = [], 0
        while True:
            windows.append(inputs[start:start + toxicity.WINDOW])
            if start + toxicity.WINDOW >= len(words):
                break
            start += toxicity.STRIDE
        top = max(plain_window_logit(p, w) for w in windows)
        assert score == pytest.approx(1 / (1 + np.exp(-top)), abs=1e-4)


def test_words_of_single_texts_are_not_learned_by_heart():
    """Toxic texts with one bad word among words of their own: held-out ones are found too."""
    rng = random.Random(11)

    def text(toxic):
        words = ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(80)]
        if toxic:
            words[rng.randrange(80)] = rng.choice(["worthless", "scum"])
        return " ".join(words).encode()
    labels = np.array([int(i % 6 == 0) for i in range(300)])
    texts = [text(y) for y in labels]
    learned = toxicity.train(texts[:240], labels[:240])
    found = toxicity.score_texts(*learned, texts[240:]) >= 0.5
    assert (found == (labels[240:] == 1)).all()


def test_toxicity_learns_and_defines_odd_rows(spark, docs):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1000, 1600):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 90))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "lowei", "loweient", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    # a bad word at the end of a very long text counts
    rows.append((1600, " ".join(rng.choice(plain) for _ in range(20_000)) + " idiot"))
    rows += [(1601, None), (None, "w1 idiot w2")]
    source = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "score", "held_out")
    marked = spark.createDataFrame(labels + [(1599, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(source, marked).collect()
    out = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1600]
    assert {r["doc_id"] for r in held} == {d for d, _ in rows if d and d < 1600
                                           and zlib.crc32(str(d).encode()) % 5 == 0}
    right = sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert out[1600]["predicted"] == 1 and out[None]["predicted"] == 1 and not out[None]["held_out"]
    assert out[1601]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got)
    # without both classes there is nothing to learn
    unlearnt = toxicity.score_toxicity(docs, marked.filter("toxic = 0")).collect()
    assert len(unlearnt) == len(ROWS) and all(r["score"] == 0 for r in unlearnt)
    assert toxicity.score_toxicity(docs.limit(0), marked.limit(0)).count() == 0


# ---- 5: mixing ----------------------------------------------------------------------------

def plain_copies(doc_id, rate, seed=17):
    parts = max(1, int(np.ceil(rate / 16)))
    copies = 0
    for part in range(1, parts + 1):
        text = f"{seed}|{'' if doc_id is None else doc_id}|{part}"
        u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        p = c = np.exp(-rate / parts)
        k = 0
        while c < u and k < 96:
            k += 1
            p *= rate / parts / k
            c += p
            copies += 1
    return copies


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 3.0}])
def test_mixing_equals_brute_force(docs, weights):
    got = mixing.mix_sources(clashing(docs, "rate", "replica"), weights=weights, total=400_000)
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(r[1] or "")
    weight = {s: (n ** 0.5 if weights is None else weights.get(s, 0)) for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * 400_000 / n for s, n in size.items()}
    wanted = Counter()
    for doc_id, text, _, source in ROWS:
        for k in range(plain_copies(doc_id, rate[source])):
            wanted[(doc_id, text, k)] += 1
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"], r["replica"]) for r in rows) == wanted
    assert len({r["shuffle_key"] for r in rows}) == len({(r["doc_id"], r["replica"]) for r in rows})
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_meets_target_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 10 else "small") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, weights={"big": 1, "small": 1}).groupBy("source").count()
    for r in got.collect():
        assert abs(r["count"] - 10_000) < 500


# ---- 1: personal data ---------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return True


def plain_base_spans(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items())
                  for m in re.finditer(p, text or "") if passes(k, m[0]))


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "é", "😀", "@", ".", "-", "+", " ", "\n", "1", "255", "256", "007", "4111111111111111",
             "4111-1111-1111-1111", "+1 (555) 010-0199", "me@x.org", "1.2.3.4", "_d@e.f", "%", "(", ")",
             "0" * 14, "x@y", ".co", "5500 0000 0000 0004"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    texts += [None, "", "a" * 200_000, "a@" * 20_000, "a@b" + ".c" * 20_000, "1 " * 30_000,
              "1.2.3.4 " * 3000, "+1" + "." * 50_000, "a@b.c_d@e.f g@h.i-j@k.l"]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "spans")
    for r in pii.find_personal_data(df).collect():
        got = [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]
        assert got == plain_base_spans(r["text"]), r["text"]


def test_checksums_and_context_decide_the_other_kinds(spark, docs):
    texts = {1: "IBAN DE89 3704 0044 0532 0130 00.", 2: "DE88370400440532013000",
             3: "GB82WEST12345698765432", 4: "her SSN is 123-45-6789", 5: "part 123-45-6789"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: {s["kind"]: s["score"] for s in r["spans"]}
           for r in pii.find_personal_data(df).collect()}
    assert "iban" in out[1] and "iban" not in out[2] and "iban" in out[3]
    assert out[1]["iban"] > out[3]["iban"]            # a context word raises the score
    assert "ssn" in out[4] and "ssn" not in out[5]
    odd = pii.find_personal_data(docs).collect()
    assert len(odd) == len(ROWS) and all(r["spans"] == [] for r in odd)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_ibans_end_where_their_country_says(spark):
    iban, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    odd = next(x for x in (f"ZZ{n:02d}12345678901234" for n in range(2, 99))
               if int(f"123456789012343535{x[2:4]}") % 97 == 1)
    texts = [(f"IBAN {spaced} BIC COBADEFFXXX", [spaced]), (f"{iban} EUR 500", [iban]),
             (f"{iban} 500", [iban]), (f"{spaced}, 12", [spaced]), (f"{spaced} and", [spaced]),
             (f"{spaced} GB82 WEST 1234 5698 7654 32 EUR", [spaced, "GB82 WEST 1234 5698 7654 32"]),
             (f"NR12 KONTO {spaced} BIC", [spaced]), (f"{iban}0", []), (f"{odd}.", [odd]),
             ("NO9386011117947 NOK", ["NO9386011117947"]),
             ("MT84MALT011000012345MTLCAST001S EUR", ["MT84MALT011000012345MTLCAST001S"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        found = [r["text"][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "iban"]
        assert found == texts[r["doc_id"]][1], r["text"]


def test_repeated_ids_with_other_texts_lose_no_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "other")
    rows = [(1, a), (2, near), (2, b), (3, c), (3, c), (4, b), (5, ""), (5, " "), (5, c + " end"),
            (None, a), (6, None), (7, a), (7, "seven only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(
        df, width=3, percent=85).collect())
    assert got == Counter([(1, a), (2, b), (3, c), (5, ""), (5, " "), (None, a), (6, None), (7, "seven only")])


# ---- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark, given):
    docs = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        path = corpus_pipeline.materialise(stage(spark, docs, SMALL), name)
        assert path.columns == given.columns
        after = texts_of(path)
        if name == "line_dedup":
            assert Counter(after) == Counter((d, t) for d, t, _, _ in plain_line_dedup(sorted(before)))
        else:
            assert set(after) <= before
        if name == "near_dedup":
            kept = {d for d, _, _, k in plain_near_duplicates(sorted(before), 5, 80) if k}
            assert sorted(d for d, _ in after) == sorted(kept)
        if name == "mixing":
            assert len(after) > len(set(after)) > 0.5 * len(before)
        docs = path
    check_packing(corpus_pipeline.packing(spark, docs, SMALL).collect(), texts_of(docs), 4096, 1)


def test_batches_are_cut_by_size():
    texts = ["x" * 10, None, "", "y" * 50, "z"]
    assert [(s.start, s.stop) for s in by_bytes(texts, 20)] == [(0, 4), (4, 5)]
    assert list(by_bytes([], 20)) == []
