"""Toxicity scores from a bidirectional GRU with attention pooling, written in numpy.

A text is a sequence of words (runs of letters, digits and non-ASCII characters, A-Z
lower-cased). A word's input is a word embedding, found by hash, next to the mean embedding of
its character trigrams, and next to its evidence: the log odds of the classes among the training
texts that hold it, less 1.5 standard errors, and the strongest such odds for and against of
its pieces of six bytes, so an unseen form of a known stem still counts.
Embeddings are shrunk by the number of training texts that hold the word, so that words of one text
cannot be learned by heart; while training, a text's own count and label are left out of both, and
words lose their embedding at random. The network reads
windows of ``WINDOW`` words that overlap by half; a text's score is its highest window score, so
one bad sentence in a long text counts in full. All windows of the whole text are scored.

Training takes a bounded sample of labelled rows outside the held-out fold: at most
``train_rows`` rows of each class, of at most ``train_chars`` characters. The labels belong to
texts, not windows, so windows are trained through a noisy-or over the text.

Rows: a null or empty text is one empty window and gets the network's bias as score. Rows that
repeat a ``doc_id`` are scored one by one. A null ``doc_id`` is scored too and never held out.
Without labelled rows of both classes every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import by_bytes, lean, prepare
from mercato.llm.shingles import mix64

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 15, 14
SEEN_BITS, PIECE = 20, 6
WORD_DIM, CHAR_DIM, FACTS, HIDDEN, ATTENTION = 8, 8, 3, 8, 8
SHRINK = 4.0        # a word of this many training texts keeps half its embedding
PRIOR = 2.0         # texts that every word is taken to have been seen in, spread like the classes
ERRORS = 1.5        # standard errors taken off the evidence
DROP = 0.9          # share of words without their embeddings in a training step

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:256] = True
_FOLD[~_IS_WORD[_FOLD]] = 32


class Words:
    """The words of a batch of texts: hash buckets, trigram codes, the words of each text, and the
    slots of words and then of their pieces in ``Seen``."""

    def __init__(self, texts: list[bytes]):
        data = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" " * PIECE, dtype=np.uint8)]
        inside = data != 32
        edge = np.diff(inside.view(np.int8))
        first, last = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        b = data.astype(np.uint32)
        code = np.zeros_like(b)
        code[1:-1] = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code *= np.uint32(0x9E3779B1)
        self.at = np.concatenate([[0], np.cumsum(last - first)])      # trigrams of each word
        self.trigrams = (code[inside] >> np.uint32(32 - CHAR_BITS)).astype(np.int32)
        with np.errstate(over="ignore"):
            # a word's hash: its trigrams, each weighted by its place
            place = (np.arange(len(self.trigrams)) - np.repeat(self.at[:-1], last - first) + 1)
            value = mix64(code[inside].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(40)))
            whole = np.add.reduceat(value, self.at[:-1]) if len(first) else value[:0]
            whole = mix64(whole)
            self.buckets = (whole >> np.uint64(64 - WORD_BITS)).astype(np.int32)
            # pieces: runs of PIECE bytes of a word with a space at each end
            run = np.zeros(len(data), dtype=np.uint64)
            for k in range(PIECE):
                run[:len(data) - PIECE + 1] |= (data[k:len(data) - PIECE + 1 + k].astype(np.uint64)
                                                << np.uint64(8 * k))
            n = np.maximum(last - first + 3 - PIECE, 0)
            self.piece_word = np.repeat(np.arange(len(n)), n)
            start = np.arange(n.sum()) + np.repeat(first - 1 - np.cumsum(n) + n, n)
            self.slots = np.concatenate([(v >> np.uint64(64 - SEEN_BITS)).astype(np.int32)
                                         for v in (whole, mix64(run[start] ^ np.uint64(1 << 63)))])
        ends = 1 + np.cumsum([len(t) + 1 for t in texts])
        until = np.searchsorted(first, ends)
        self.counts = np.diff(until, prepend=0)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word index of every place of every window, -1 beyond the text; text of each window)."""
        n = np.maximum(1, -(-(self.counts - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        until = np.cumsum(self.counts)
        index = (until - self.counts)[text][:, None] + step[:, None] * STRIDE + np.arange(WINDOW)
        return np.where(index < until[text][:, None], index, -1), text


class Seen:
    """In how many training texts of each class a word or piece was seen, by hash (4 MB)."""

    def __init__(self, texts: list[bytes], labels: np.ndarray, step: int = 256):
        self.counts = np.zeros((2, 1 << SEEN_BITS), dtype=np.uint16)
        self.totals = np.bincount(labels, minlength=2).astype(np.float64)
        for i in range(0, len(texts), step):
            words = Words(texts[i:i + step])
            pairs = np.unique(self._texts(words).astype(np.int64) << SEEN_BITS | words.slots)
            np.add.at(self.counts, (labels[i + (pairs >> SEEN_BITS)], pairs & (1 << SEEN_BITS) - 1), 1)

    @staticmethod
    def _texts(words: Words) -> np.ndarray:
        """The text of each slot."""
        text = np.repeat(np.arange(len(words.counts)), words.counts)
        return np.concatenate([text, text[words.piece_word]])

    def facts(self, words: Words, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(share of its embedding that each word keeps; evidence of each word, and the strongest
        for and against of its pieces). With ``label`` the texts are training texts of these
        classes and do not vouch for themselves."""
        seen = self.counts[:, words.slots].astype(np.float32)
        if label is not None:
            seen[label.astype(int)[self._texts(words)], np.arange(len(words.slots))] -= 1
        share = (PRIOR * self.totals / max(self.totals.sum(), 1)).astype(np.float32)
        some = seen + share[:, None]
        odds = np.log(some[1] / some[0]) - np.log(share[1] / share[0])
        sure = np.abs(odds) - np.float32(ERRORS) * np.sqrt((1 / some).sum(axis=0))
        sure = np.sign(odds) * np.maximum(sure, 0)
        n = len(words.buckets)
        evidence = np.zeros((n, FACTS), dtype=np.float32)
        evidence[:, 0] = sure[:n]
        np.maximum.at(evidence[:, 1], words.piece_word, sure[n:])
        np.minimum.at(evidence[:, 2], words.piece_word, sure[n:])
        texts = seen[:, :n].sum(axis=0)
        return texts / (texts + np.float32(SHRINK)), evidence


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def initial_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = WORD_DIM + CHAR_DIM + FACTS

    def draw(scale, *shape):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"word": draw(0.1, 1 << WORD_BITS, WORD_DIM), "char": draw(0.3, 1 << CHAR_BITS, CHAR_DIM),
         "Wa": draw(0.3, 2 * HIDDEN, ATTENTION), "ba": draw(0, ATTENTION),
         "va": draw(0.3, ATTENTION), "w": draw(0.3, 2 * HIDDEN),
         "b": np.full(1, -3.0, np.float32)}
    for side in "fr":
        p |= {f"Wx{side}": draw(0.3, d, 3 * HIDDEN), f"Wh{side}": draw(0.3, HIDDEN, 3 * HIDDEN),
              f"bx{side}": draw(0, 3 * HIDDEN)}
    return p


def word_inputs(p: dict, words: Words, facts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Input vectors of all words, and a row of zeros at the end for places beyond the text."""
    n = len(words.buckets)
    keeps, evidence = facts
    out = np.zeros((n + 1, WORD_DIM + CHAR_DIM + FACTS), dtype=np.float32)
    out[:n, :WORD_DIM] = p["word"][words.buckets] * keeps[:, None]
    out[:n, -FACTS:] = evidence
    if n:
        size = np.diff(words.at)[:, None].astype(np.float32)
        chars = np.add.reduceat(p["char"][words.trigrams], words.at[:-1], axis=0) / size
        out[:n, WORD_DIM:-FACTS] = chars * keeps[:, None]
    return out


def _gru(gates: np.ndarray, mask: np.ndarray, Wh: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of one direction; ``gates`` and ``mask`` are in the
    order in which the direction reads. ``keep`` collects what the backward pass needs."""
    steps, batch, _ = gates.shape
    states = np.empty((steps, batch, HIDDEN), dtype=np.float32)
    h = np.zeros((batch, HIDDEN), dtype=np.float32)
    for t in range(steps):
        own = h @ Wh
        rz = _sigmoid(gates[t, :, :2 * HIDDEN] + own[:, :2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN:] + r * own[:, 2 * HIDDEN:])
        new = n + z * (h - n)
        if keep is not None:
            keep.append((h, r, z, n, own[:, 2 * HIDDEN:]))
        h = new if mask[t].all() else np.where(mask[t][:, None], new, h)
        states[t] = h
    return states


def _attend(p: dict, states: np.ndarray, mask: np.ndarray):
    u = np.tanh(states @ p["Wa"] + p["ba"])
    e = np.where(mask, u @ p["va"], np.float32(-30))
    a = np.exp(e - e.max(axis=0))
    a *= mask
    a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tb,tbh->bh", a, states)
    return u, a, pooled, pooled @ p["w"] + p["b"][0]


def window_logits(p: dict, inputs: np.ndarray, index: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Logit of every window; ``index`` points into ``inputs`` (-1: beyond the text)."""
    projected = {s: inputs @ p[f"Wx{s}"] + p[f"bx{s}"] for s in "fr"}
    out = np.empty(len(index), dtype=np.float32)
    for i in range(0, len(index), batch):
        at = index[i:i + batch].T
        mask = at >= 0
        forward = _gru(projected["f"][at], mask, p["Whf"], None)
        back = _gru(projected["r"][at[::-1]], mask[::-1], p["Whr"], None)[::-1]
        out[i:i + batch] = _attend(p, np.concatenate([forward, back], axis=2), mask)[3]
    return out


def _gru_back(d_states, mask, Wh, kept, gates_grad):
    """Gradients of one direction: fills ``gates_grad`` (time, batch, 3 * hidden), returns that
    of ``Wh``."""
    dWh = np.zeros_like(Wh)
    dh = np.zeros_like(d_states[0])
    for t in range(len(d_states) - 1, -1, -1):
        h, r, z, n, own_n = kept[t]
        m = mask[t][:, None]
        dh = dh + d_states[t]
        dnew = np.where(m, dh, 0)
        dz = dnew * (h - n) * z * (1 - z)
        dn = dnew * (1 - z) * (1 - n * n)
        dr = dn * own_n * r * (1 - r)
        d_own = np.concatenate([dr, dz, dn * r], axis=1)
        gates_grad[t] = np.concatenate([dr, dz, dn], axis=1)
        dWh += h.T @ d_own
        dh = np.where(m, dnew * z, dh) + d_own @ Wh.T
    return dWh


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by row number."""
    return np.stack([np.bincount(rows, values[:, d], minlength=n) for d in range(values.shape[1])],
                    axis=1).astype(np.float32)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def gradients(p: dict, words: Words, facts: tuple[np.ndarray, np.ndarray], index: np.ndarray,
              text: np.ndarray, label: np.ndarray):
    """Loss of the noisy-or over each text's windows, and the gradient of every parameter."""
    inputs = word_inputs(p, words, facts)
    at = index.T
    mask = at >= 0
    x = inputs[at]
    kept: dict[str, list] = {"f": [], "r": []}
    forward = _gru(x @ p["Wxf"] + p["bxf"], mask, p["Whf"], kept["f"])
    back = _gru(x[::-1] @ p["Wxr"] + p["bxr"], mask[::-1], p["Whr"], kept["r"])[::-1]
    states = np.concatenate([forward, back], axis=2)
    u, a, pooled, logit = _attend(p, states, mask)

    window_p = _sigmoid(logit.astype(np.float64))
    quiet = np.bincount(text, np.log1p(-np.minimum(window_p, 1 - 1e-9)), minlength=len(label))
    doc_p = np.clip(-np.expm1(quiet), 1e-7, 1)
    loss = np.where(label, -np.log(doc_p), -quiet).mean()
    pull = np.where(label, -(1 - doc_p) / doc_p, 1.0) / len(label)
    d_logit = (pull[text] * window_p).astype(np.float32)

    g = {"w": pooled.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["w"]
    d_states = a[:, :, None] * d_pooled
    d_a = np.einsum("bh,tbh->tb", d_pooled, states)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    d_u = d_e[:, :, None] * p["va"] * (1 - u * u)
    g["va"] = d_e.ravel() @ _flat(u)
    g["ba"] = d_u.sum(axis=(0, 1))
    g["Wa"] = _flat(states).T @ _flat(d_u)
    d_states = d_states + d_u @ p["Wa"].T
    d_x = np.zeros_like(x)
    for side, part, order in (("f", slice(0, HIDDEN), 1), ("r", slice(HIDDEN, None), -1)):
        d_gates = np.zeros((*mask.shape, 3 * HIDDEN), dtype=np.float32)
        g[f"Wh{side}"] = _gru_back(d_states[::order, :, part], mask[::order], p[f"Wh{side}"],
                                   kept[side], d_gates)
        d_gates = d_gates[::order]
        g[f"bx{side}"] = d_gates.sum(axis=(0, 1))
        g[f"Wx{side}"] = _flat(x).T @ _flat(d_gates)
        d_x += d_gates @ p[f"Wx{side}"].T
    n = len(inputs) - 1
    d_word = _scatter(np.where(at < 0, n, at).ravel(), d_x.reshape(-1, x.shape[2]), n + 1)[:n]
    d_word = d_word[:, :-FACTS] * facts[0][:, None]
    g["word"] = _scatter(words.buckets, d_word[:, :WORD_DIM], len(p["word"]))
    size = np.diff(words.at)
    g["char"] = _scatter(words.trigrams, np.repeat(d_word[:, WORD_DIM:] / size[:, None], size, axis=0),
                         len(p["char"]))
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = 5, batch: int = 48,
          rate: float = 0.01, decay: float = 1e-4, least_steps: int = 250,
          seed: int = 7) -> tuple[dict[str, np.ndarray], Seen]:
    """Fit the network with Adam; same texts and labels, same parameters. Returns them and the
    words seen."""
    seen = Seen(texts, labels)
    p = initial_parameters(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    per_epoch = -(-len(texts) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps = epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            own = order[i:i + batch]
            words = Words([texts[j] for j in own])
            index, text = words.windows()
            keeps, evidence = seen.facts(words, labels[own])
            keeps *= rng.random(len(keeps)) >= DROP
            _, g = gradients(p, words, (keeps, evidence), index, text, labels[own].astype(bool))
            step += 1
            speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in p.items():
                grad = np.clip(g[k], -1, 1)
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad * grad - second[k])
                v -= speed * (first[k] / (1 - 0.9 ** step)
                              / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6) + decay * v)
    return p, seen


def score_texts(p: dict, seen: Seen, texts: list[bytes]) -> np.ndarray:
    """Highest window score of each text."""
    words = Words(texts)
    index, text = words.windows()
    keeps, evidence = seen.facts(words)
    logits = window_logits(p, word_inputs(p, words, (keeps * np.float32(1 - DROP), evidence)), index)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, logits)
    return _sigmoid(top.astype(np.float64))


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0,
                      F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int, train_chars: int):
    """(texts, labels, log odds of label 1 among all usable rows) of at most ``train_rows`` rows of each class outside the held-out fold,
    chosen by a hash of their id, so that the choice follows no order of the table."""
    marked = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~is_held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # only ids and lengths are ranked; texts are fetched for the rows that were chosen
    usable = (docs.select("doc_id", F.length("text").alias("n"))
              .filter(F.col("n").between(1, train_chars)).join(marked, "doc_id")
              .groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))
              .withColumn("lot", F.xxhash64("doc_id")))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = [r for c in (0, 1) for r in usable.filter(F.col("toxic") == c)
              .orderBy("lot", "doc_id").limit(train_rows).collect()]
    if len(counts) < 2:
        return [], np.empty(0, int), 0.0
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen],
                                            "doc_id long, toxic int")
    rows = (docs.filter(F.length("text").between(1, train_chars)).select("doc_id", "text")
            .join(F.broadcast(ids), "doc_id")
            # of rows that repeat an id, the one with the smallest text is learned from
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect())
    odds = math.log(counts[1] / counts[0])
    return [r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows]), odds


def score_toxicity(docs: DataFrame, labels: DataFrame, *, train_rows: int = 2000,
                   train_chars: int = 6000) -> DataFrame:
    """The documents with held_out, score and predicted added (input columns of these names are
    replaced)."""
    spark = prepare(docs.sparkSession)
    texts, marks, odds = training_sample(docs, labels, train_rows, train_chars)
    learned = None
    if texts:
        learned = train(texts, marks)
        # the sample holds the classes in other shares than the labelled rows do
        learned[0]["b"] += np.float32(odds - math.log(marks.sum() / (1 - marks).sum()))
    model = spark.sparkContext.broadcast(learned)       # under 8 MB, whatever the input
    names = ("held_out", "score", "predicted")
    source = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = model.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            scores = np.zeros(len(texts))
            if learned is not None:
                for part in by_bytes(texts, 400_000):
                    scores[part] = score_texts(*learned, texts[part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=schema.names)

    return (source.mapInArrow(lean(score), schema)
            .withColumn("held_out", is_held_out(F.col("doc_id")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
