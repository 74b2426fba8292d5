"""URL filtering by rules and by the ratio of two character language models.

Accepted and rejected URLs, as the rules mark them, each train a variable-order Markov model over
the bytes of the whole URL after ``://`` (all of it where there is none): counts of every byte
after its 0 to ``ORDER`` preceding bytes, added up by Spark over all marked URLs and smoothed by
interpolating each order with the one below (Witten-Bell). Counts are exact and stay in a Spark table that grows with
the distinct n-grams of all URLs; URLs are scored in blocks, each of which is joined to the counts
of its own distinct n-grams. A URL without a rule is judged by its length-normalised
log-likelihood difference against a threshold. That is calibrated on a fold of the marked URLs,
scored with the counts of those outside it; verdicts come from the counts of all.

Rows: a null URL or one without ``://`` has an empty host and path and fits no rule; like every
URL without a rule it is judged by its ratio (a null is read as an empty text, which has one too:
both models give its end a probability). Every URL is allowed when either model has no training
rows. An empty table gives no rows; repeated rows are judged one by one but counted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import by_bytes, materialise, prepare

ORDER = 5
FOLD = 10
SIDES = ("good", "bad")      # accepted, rejected
FIT = "fit_"                 # before a side: its count outside the calibration fold
COUNTS = [*SIDES, *(FIT + side for side in SIDES)]
# A block is so many rows of a partition; a text of more than LONG characters is one by itself.
BLOCK_BITS = 10
LONG = 4_096
SLICE = 1_000_000            # characters that are taken apart at once


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url) -> tuple:
    """(host, path) columns: what follows the first ``://`` up to a slash, question mark or hash,
    A-Z lower-cased, and then up to a question mark or hash."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def read_text(url):
    """What the models read: the URL after its first ``://``, or all of it; empty for a null."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
                      .otherwise(url), F.lit(""))


def matching_rule(rules: list[Rule]):
    """The text of the longest rule that fits host and path, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) \
            & F.col("path").startswith(rule.path)
        found = F.when(fits, rule.text).otherwise(found)
    return found


def _symbols(texts: list[bytes]):
    """Bytes of all texts, each after ORDER zero bytes; which of them are symbols; whose they are.
    Every text ends with a 0x01 symbol, so lengths are modelled too."""
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(pad + t.replace(b"\0", b"\1") + b"\1" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + ORDER * (owner + 1)
    return data, at, owner


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of context + symbol, text of each symbol); keys have one row per order. A key is the
    order and the bytes themselves, so different n-grams never share one; without its last byte
    (``key >> 8``) it names the context."""
    data, at, owner = _symbols(texts)
    wide = data.astype(np.int64)
    keys, past = [], np.zeros(len(at), dtype=np.int64)
    for order in range(ORDER + 1):
        if order:
            past = past | (wide[at - order] << 8 * order)
        keys.append(past | wide[at] | order << 8 * (ORDER + 1))
    return np.array(keys), owner


def _encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def block_grams(urls: DataFrame) -> DataFrame:
    """block, key and COUNTS, for every n-gram of every text: how often accepted (``good``) and
    rejected (``bad``) texts hold it, and how often those outside the fold do. All are 0 where only
    texts without a mark hold it. A block's key may come more than once. ``urls``: block, text,
    accepted (null: no mark), in_fold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, rows in batch.groupby("block"):
                texts = _encoded(rows["text"])
                marks = [(rows["accepted"] == side).to_numpy(dtype=float) for side in (True, False)]
                marks += [m * ~rows["in_fold"].to_numpy(dtype=bool) for m in marks]
                for part in by_bytes(texts, SLICE):
                    keys, owner = grams(texts[part])
                    for of_order in keys:
                        values, at = np.unique(of_order, return_inverse=True)
                        yield pd.DataFrame({"block": block, "key": values} | {
                            name: np.bincount(at, m[part][owner], len(values)).astype(np.int64)
                            for name, m in zip(COUNTS, marks)})

    return urls.select("block", "text", "accepted", "in_fold").mapInPandas(
        count, "block long, key long, " + ", ".join(f"{name} long" for name in COUNTS))


def add_up(found: DataFrame) -> DataFrame:
    """The model, a row per n-gram: key, its counts, and of its context how many symbols (n_) and
    how many distinct ones (kinds_) follow. A context has at most 256 rows."""
    total = found.groupBy("key").agg(*[F.sum(name).alias(name) for name in COUNTS])
    same = Window.partitionBy(F.shiftright("key", 8))
    return total.select("key", *COUNTS, *[F.sum(name).over(same).alias(f"n_{name}") for name in COUNTS],
                        *[F.count_if(F.col(name) > 0).over(same).alias(f"kinds_{name}")
                          for name in COUNTS])


def count_bins(urls: DataFrame) -> DataFrame:
    """The model of all ``urls`` (text, accepted), none of them in the fold."""
    return add_up(block_grams(urls.withColumns({"block": F.lit(0).cast("long"),
                                                "in_fold": F.lit(False)})))


def load_model(counts: DataFrame | pd.DataFrame) -> pd.DataFrame:
    """Rows of the model in the order of their keys, for ``log_ratio``."""
    rows = counts if isinstance(counts, pd.DataFrame) else counts.toPandas()
    return rows.drop_duplicates("key").sort_values("key", ignore_index=True)


def _find(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``have``, and which of them are there."""
    at = np.minimum(np.searchsorted(have, wanted), max(len(have) - 1, 0))
    return at, (have[at] == wanted if len(have) else np.zeros(len(wanted), dtype=bool))


def log_ratio(model: pd.DataFrame, texts: list[bytes], counted: str = "") -> np.ndarray:
    """Mean over a text's symbols of log P(accepted) - log P(rejected), from the counts whose names
    begin with ``counted``."""
    keys, owner = grams(texts)
    have = model["key"].to_numpy()
    columns = {c: model[c].to_numpy(dtype=float) for c in model.columns if c != "key"}
    chance = {side: np.full(len(owner), 1 / 256) for side in SIDES}
    for of_order in keys:
        at, known = _find(have, of_order)
        before, followed = _find(have >> 8, of_order >> 8)
        for side in SIDES:
            name = counted + side
            seen = np.where(known, columns[name][at], 0) if len(have) else 0
            n = np.where(followed, columns[f"n_{name}"][before], 0) if len(have) else 0
            kinds = columns[f"kinds_{name}"][before] if len(have) else 0
            chance[side] = np.where(n > 0, (seen + kinds * chance[side])
                                    / np.where(n > 0, n + kinds, 1), chance[side])
    size = np.bincount(owner, minlength=len(texts))
    logs = np.log(chance["good"]) - np.log(chance["bad"])
    return np.bincount(owner, logs, minlength=len(texts)) / size


def _scores(rows: DataFrame, found: DataFrame, keep: list[str], columns: str) -> DataFrame:
    """``keep`` (with text and in_fold), ratio and, for the fold, fit_ratio: every block of rows
    meets the model's rows of its own n-grams."""

    def ratios(model: pd.DataFrame, texts: list[bytes], counted: str) -> np.ndarray:
        out = np.zeros(len(texts))
        for part in by_bytes(texts, SLICE):
            out[part] = log_ratio(model, texts[part], counted)
        return out

    def score(urls: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        model, texts = load_model(counts.drop(columns="block")), _encoded(urls["text"])
        fit = np.full(len(texts), np.nan)
        fold = np.flatnonzero(urls["in_fold"])
        fit[fold] = ratios(model, [texts[i] for i in fold], FIT)
        return urls[keep].assign(ratio=ratios(model, texts, ""), fit_ratio=fit)

    needed = found.select("block", "key").join(add_up(found), "key")
    return rows.select("block", *keep).groupBy("block").cogroup(
        needed.groupBy("block")).applyInPandas(score, columns)


def calibrated_threshold(marked: DataFrame) -> float:
    """The threshold on ``ratio`` with the fewest wrong verdicts (the middle of the best gap),
    from a histogram of fixed size over the calibration fold."""
    step = 1 / 64
    bins = marked.groupBy(F.greatest(F.lit(-640), F.least(F.lit(640), F.floor(F.col("ratio") / step)))
                          .alias("bin")).agg(F.count_if("accepted").alias("good"),
                                             F.count_if(~F.col("accepted")).alias("bad"))
    rows = bins.orderBy("bin").collect()         # at most 1281 rows
    good, bad = np.zeros(1281), np.zeros(1281)
    for r in rows:
        good[r["bin"] + 640], bad[r["bin"] + 640] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return 0.0
    # balanced errors when all bins below cut b are rejected
    wrong = np.append(0, np.cumsum(good)) / good.sum() + 1 - np.append(0, np.cumsum(bad)) / bad.sum()
    best = np.flatnonzero(np.isclose(wrong, wrong.min()))
    return float((best.min() + best.max()) / 2 - 640) * step


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio for every page."""
    prepare(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    verdicts = {r.text: r.verdict for r in rules}
    by_rule = F.create_map(*[F.lit(x) for item in verdicts.items() for x in item])[F.col("rule")]
    in_fold = F.pmod(F.crc32(F.concat("host", "path").cast("binary")), F.lit(FOLD)) == 0
    row = F.monotonically_increasing_id()
    parts = materialise(
        pages.select(F.col("page_id").cast("string").alias("page_id"),  # a null makes longs floats
                     F.col("url").cast("string").alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"),
                read_text(F.col("url")).alias("text"))
        .withColumn("rule", matching_rule(rules))
        .withColumn("in_fold", in_fold)
        .withColumn("block", F.when(F.length("text") > LONG, -1 - row)
                    .otherwise(F.shiftright(row, BLOCK_BITS))), "urls")
    marks = parts.withColumn("accepted", by_rule == "allow")
    found = materialise(block_grams(marks), "url-grams")
    scored = materialise(_scores(
        parts, found, ["page_id", "host", "path", "rule", "text", "in_fold"],
        "page_id string, host string, path string, rule string, text string, in_fold boolean, "
        "ratio double, fit_ratio double"), "url-ratios")
    classes = {(r["accepted"], r["in_fold"]) for r in marks.filter("accepted IS NOT NULL")
               .select("accepted", "in_fold").distinct().collect()}      # at most 4 rows
    sides = len({side for side, _ in classes})
    limit = 0.0
    if len({side for side, fold in classes if not fold}) == 2:
        limit = calibrated_threshold(scored.filter(F.col("rule").isNotNull() & F.col("in_fold"))
                                     .select((by_rule == "allow").alias("accepted"),
                                             F.col("fit_ratio").alias("ratio")))
    accepted = F.lit(sides < 2) | (F.col("ratio") >= limit)
    verdict = F.coalesce(by_rule, F.when(accepted, "allow").otherwise("block"))
    return scored.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule",
                         "ratio", verdict.alias("verdict"))
