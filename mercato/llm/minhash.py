"""Near-duplicate texts by an inverted join on MinHash signature coordinates.

1. Each text's distinct word shingles give a size, a fingerprint and a signature of k MinHash
   coordinates. Texts with the same set form a class; only classes go on.
2. A class is posted under its (coordinate, value) pairs. Two classes at the similarity
   threshold agree on at least ``t`` of the k coordinates but for a chance of ``miss``, so with
   all pairs ordered by how many classes hold them, rarest first, they share one of their first
   k - t + 1 (prefix merging). Pairs that one class alone holds are never posted, and common
   ones (a passage in many texts) fall out of the prefixes.
3. Within a posting list, classes are first compared to the list's smallest member only. Pairs
   that agree on ``t`` coordinates are confirmed on the full sets and joined to components. Lists
   whose members are still apart are then compared across (skip merging: what is joined already
   is never compared again), in blocks of bounded size; of each list only a spanning forest of
   the agreeing pairs goes on, so no pairs of a group are ever listed.
4. Classes that agreement connects form a cluster. The texts of a cluster that holds several
   components meet in blocks of bounded size: those outside the largest component are compared
   with all others on signatures and then on full shingle sets of the whole texts. Links that
   join components complete them.

Rows: null, empty or word-less texts have no shingles and link with nothing. Rows that repeat a
``doc_id`` are one node: they share its component. Rows with a null ``doc_id`` link with nothing
and have a null component; they are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_bytes, lean, materialise, prepare, stream_blocks
from mercato.llm.components import connected_components
from mercato.llm.shingles import fingerprints, shingle_sets, signatures


def match_threshold(k: int, similarity: float, miss: float) -> int:
    """Largest t for which a pair at ``similarity`` agrees on fewer than t of k coordinates with
    a chance of at most ``miss``."""
    below = 0.0
    for t in range(k + 1):
        below += comb(k, t) * similarity ** t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(t, 1)
    return k


def signature_table(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sig (k coordinates)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for part in by_bytes(texts, 1_500_000):
                sets = shingle_sets(texts[part], width)
                f = fingerprints(sets)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].to_numpy(),
                                    "n_shingles": sets.sizes, "f1": f[:, 0], "f2": f[:, 1],
                                    "sig": list(signatures(sets, k).view(np.int32))})

    return (docs.filter("doc_id IS NOT NULL")
            .select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .mapInPandas(lean(sign), "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>"))


def prefix_postings(classes: DataFrame, k: int, t: int) -> DataFrame:
    """token, cls, df: every class under those of its k - t + 1 rarest tokens that other classes
    hold too."""
    tokens = (classes.select("cls", F.posexplode("sig").alias("at", "value"))
              .select("cls", F.expr("shiftleft(cast(at as long), 32) | (value & 4294967295L)")
                      .alias("token")))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    own = (tokens.join(shared, "token").groupBy("cls")
           .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own")))
    room = F.lit(k - t + 1) - (F.lit(k) - F.size("own"))
    return (own.filter(room > 0)
            .select("cls", F.explode(F.slice("own", F.lit(1), room)).alias("p"))
            .select("p.token", "cls", "p.df"))


def _agreeing(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0),
                       lambda n, same: n + same)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
              .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = (batch["text_a"].str.len() + batch["text_b"].str.len()).to_numpy()
            for part in by_bytes([range(n) for n in sizes], 1_500_000):
                rows = batch.iloc[part]
                distinct = {t: i for i, t in enumerate(
                    dict.fromkeys([*rows["text_a"], *rows["text_b"]]))}
                sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in distinct], width)
                keep = []
                for x, y in zip(rows["text_a"], rows["text_b"]):
                    one, two = sets.of(distinct[x]), sets.of(distinct[y])
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    union = len(one) + len(two) - both
                    keep.append(both > 0 and 100 * both >= percent * union)
                yield rows.loc[keep, ["a", "b"]]

    return joined.select("a", "b", "text_a", "text_b").mapInPandas(lean(check), "a long, b long")


class _Forest:
    """Union-find that records the joins it made."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.joins: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int, a: int, b: int) -> None:
        """Join the trees of x and y for the sake of the link (a, b)."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.joins.append((a, b))


class _Members:
    """Rows of one list or cluster: class, component, set size and signature of each, and the
    full sets where they are at hand."""

    def __init__(self, rows: pd.DataFrame, sig: np.ndarray, sets=None):
        self.cls, self.comp = rows["cls"].to_numpy(), rows["comp"].to_numpy()
        self.n = sets.sizes if sets is not None else rows["n_shingles"].to_numpy()
        self.sig, self.sets = sig, sets

    def agreeing(self, x: int, other: _Members, t: int, percent: int) -> np.ndarray:
        """Rows of ``other`` from other components that agree with row x on t coordinates."""
        ok = (other.comp != self.comp[x]) & (
            100 * np.minimum(other.n, self.n[x]) >= percent * np.maximum(other.n, self.n[x]))
        y = np.flatnonzero(ok)
        return y[(other.sig[y] == self.sig[x]).sum(axis=1) >= t]


def _apart(comp: np.ndarray) -> np.ndarray:
    """Rows outside the largest component."""
    _, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(inverse != counts.argmax())


class _List:
    """A block of a posting list; gathers a spanning forest of the agreeing pairs."""

    def __init__(self, rows: pd.DataFrame, t: int, percent: int):
        self.t, self.percent, self.forest = t, percent, _Forest()
        self.own = _Members(rows, np.stack(rows["sig"].to_numpy()))
        for x in _apart(self.own.comp):
            self._join(self.own, x)

    def _join(self, members: _Members, x: int) -> None:
        for y in members.agreeing(x, self.own, self.t, self.percent):
            self.forest.join(int(members.comp[x]), int(self.own.comp[y]),
                             int(members.cls[x]), int(self.own.cls[y]))

    def ask(self, rows: pd.DataFrame) -> None:
        members = _Members(rows, np.stack(rows["sig"].to_numpy()))
        for x in range(len(rows)):
            self._join(members, x)

    def results(self) -> pd.DataFrame:
        return pd.DataFrame(self.forest.joins, columns=["a", "b"], dtype="int64")


def list_forest(members: DataFrame, t: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) that connect whatever agreement on ``t`` coordinates connects within each
    posting list. ``members``: token, cls, df, comp, n_shingles, sig."""
    key = ["token", "block"]
    columns = [*key, "asking", "cls", "comp", "n_shingles", "sig"]
    own = (members.withColumn("blocks", F.ceil(F.col("df") / block))
           .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
           .withColumn("asking", F.lit(0)))
    later = (own.filter("block + 1 < blocks").withColumn("asking", F.lit(1))
             .withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1))))
    # two thirds of all lists have two members; these need no block
    pairs = members.groupBy("token").agg(
        F.count("*").alias("n"), F.min_by(F.struct("cls", "comp", "n_shingles", "sig"), "cls").alias("x"),
        F.max_by(F.struct("cls", "comp", "n_shingles", "sig"), "cls").alias("y")).filter("n = 2")
    pairs = (pairs.filter("x.comp <> y.comp")
             .filter(100 * F.least("x.n_shingles", "y.n_shingles")
                     >= percent * F.greatest("x.n_shingles", "y.n_shingles"))
             .filter(_agreeing("x.sig", "y.sig") >= t)
             .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
    dealt = (own.filter("df > 2").select(columns).unionByName(later.select(columns))
             .repartition(*key).sortWithinPartitions(*key, "asking"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return stream_blocks(batches, key, "asking", lambda rows: _List(rows, t, percent), 1024)

    return dealt.mapInPandas(lean(stream), "a long, b long").unionByName(pairs).distinct()


def _common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``one`` with all sets of ``two``."""
    values, place = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    sizes = [len(s) for s in [*one, *two]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = row < len(one)
    # only values on both sides count; columns are taken in slices of bounded size
    both = (np.bincount(place[left], minlength=len(values)) > 0) \
        & (np.bincount(place[~left], minlength=len(values)) > 0)
    column = (np.cumsum(both) - 1)[place]
    use = both[place]
    row, column = row[use], column[use]
    out = np.zeros((len(one), len(two)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(both.sum()), 16_384):
        part = slice(*np.searchsorted(column, [start, start + 16_384]))
        table = np.zeros((len(sizes), 16_384), dtype=np.float32)
        table[row[part], column[part] - start] = 1
        out += table[:len(one)] @ table[len(one):].T
    return out


class _Cluster:
    """A block of a cluster's texts; gathers confirmed links that join components."""

    def __init__(self, rows: pd.DataFrame, options: tuple):
        self.t, self.percent, self.width, self.k = options
        self.forest = _Forest()
        self.own = self._members(rows)
        self._link(self.own, _apart(self.own.comp))

    def _members(self, rows: pd.DataFrame) -> _Members:
        sets = shingle_sets([x.encode("utf-8", "surrogatepass") for x in rows["text"]], self.width)
        return _Members(rows, signatures(sets, self.k), sets)

    def _link(self, members: _Members, rows: np.ndarray) -> None:
        near = {int(x): y for x in rows
                if len(y := members.agreeing(x, self.own, self.t, self.percent))}
        if not near:
            return
        columns = np.unique(np.concatenate(list(near.values())))
        common = _common_counts([members.sets.of(x) for x in near],
                                [self.own.sets.of(y) for y in columns])
        for i, (x, ys) in enumerate(near.items()):
            same = common[i, np.searchsorted(columns, ys)]
            union = members.n[x] + self.own.n[ys] - same
            for y in ys[100 * same >= self.percent * union]:
                self.forest.join(int(members.comp[x]), int(self.own.comp[y]),
                                 int(members.cls[x]), int(self.own.cls[y]))

    def ask(self, rows: pd.DataFrame) -> None:
        self._link(self._members(rows), np.arange(len(rows)))

    def results(self) -> pd.DataFrame:
        return pd.DataFrame(self.forest.joins, columns=["a", "b"], dtype="int64")


def cluster_links(clusters: DataFrame, sized: DataFrame, docs: DataFrame, *, width: int,
                  percent: int, k: int, t: int, block: int, block_shingles: int) -> DataFrame:
    """Confirmed links (a, b) that join the components of each cluster. ``clusters``: cls, cluster,
    comp; blocks hold about ``block`` texts and ``block_shingles`` shingles."""
    members = clusters.join(sized.select("cls", "n_shingles"), "cls")
    shares = members.groupBy("cluster", "comp").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    whole = shares.groupBy("cluster").agg(
        F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"),
        F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("size") / block_shingles)).alias("blocks")
    ).filter("comps > 1").drop("comps")
    texts = docs.select(F.col("doc_id").cast("long").alias("cls"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = (clusters.join(whole, "cluster").join(texts, "cls")
           .withColumn("home", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks"))))
    # a text outside the largest component meets every block, the others only their own
    visits = F.when(F.col("comp") != F.col("main"), F.sequence(F.lit(0), F.col("blocks") - 1)) \
        .otherwise(F.array("home"))
    dealt = (own.withColumn("block", F.explode(visits))
             .withColumn("asking", (F.col("block") != F.col("home")).cast("int"))
             .select("cluster", "block", "asking", "cls", "comp", "text")
             .repartition("cluster", "block").sortWithinPartitions("cluster", "block", "asking"))
    options = (t, percent, width, k)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return stream_blocks(batches, ["cluster", "block"], "asking",
                             lambda rows: _Cluster(rows, options), block)

    return dealt.mapInPandas(lean(stream), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, k: int = 64,
                    miss: float = 1e-7, block: int = 512,
                    block_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id =
    component_id) for every row; texts are linked when 100 * intersection >= percent * union of
    their ``width``-word shingle sets."""
    prepare(docs.sparkSession)
    t = match_threshold(k, percent / 100, miss)
    sets = materialise(signature_table(docs, width, k), "sets")
    # a class is named by its least doc_id: rows that repeat a doc_id may name one class each way
    classes = materialise(
        sets.filter("n_shingles > 0").groupBy("n_shingles", "f1", "f2")
        .agg(F.min("doc_id").alias("cls"), F.first("sig").alias("sig")), "classes")
    postings = materialise(prefix_postings(classes, k, t), "postings")

    sized = classes.select("cls", "n_shingles", "sig")

    def described(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures allow a link."""
        a, b = (sized.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n_{x}"),
                             F.col("sig").alias(f"sig_{x}")) for x in "ab")
        return (pairs.join(b, "b").join(a, "a")
                .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                .filter(_agreeing("sig_a", "sig_b") >= t).select("a", "b"))

    centres = postings.groupBy("token").agg(F.min("cls").alias("a"))
    star = (postings.join(centres, "token").filter("cls <> a")
            .select("a", F.col("cls").alias("b")).distinct())
    star = materialise(described(star).distinct(), "star")
    first = materialise(confirmed(star, docs, width, percent).distinct(), "star-links")
    # copies whose class has another row's name: rows that repeat a doc_id tie classes together
    same = sets.filter("n_shingles > 0").join(classes.drop("sig"), ["n_shingles", "f1", "f2"])
    same = same.filter("doc_id <> cls").select(F.col("cls").alias("a"), F.col("doc_id").alias("b"))
    parts = materialise(connected_components(first), "components")

    # clusters: what agreement on t coordinates connects
    near = materialise(connected_components(star), "near")
    placed = (postings.join(near, F.col("cls") == F.col("node"), "left")
              .select("token", "cls", "df", F.coalesce("component", "cls").alias("comp")))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")) \
        .filter("x <> y").select("token")
    members = placed.join(mixed, "token").join(sized, "cls")
    more = list_forest(members, t, percent, block)
    cluster = connected_components(more.unionByName(
        near.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    clusters = materialise(
        cluster.select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
        .join(parts, F.col("cls") == F.col("node"), "left")
        .select("cls", "cluster", F.coalesce("component", "cls").alias("comp")), "clusters")
    second = cluster_links(clusters, sized, docs, width=width, percent=percent, k=k, t=t,
                           block=block, block_shingles=block_shingles)
    links = (second.unionByName(same)
             .unionByName(parts.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    final = connected_components(links)
    named = docs.filter("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unnamed = signature_table(named.withColumn("doc_id", F.lit(0)), width, 1).select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles",
        F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return (sets.select("doc_id", "n_shingles")
            .join(final, F.col("doc_id") == F.col("node"), "left")
            .withColumn("component_id", F.coalesce("component", "doc_id"))
            .select("doc_id", "n_shingles", "component_id",
                    (F.col("doc_id") == F.col("component_id")).alias("kept"))
            .unionByName(unnamed))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that represent their group: one row per component of linked texts, the one of
    the smallest doc_id, then of the smallest MD5 of its text. Unlike in ``near_duplicates``, rows
    that repeat a doc_id are nodes of their own, so a text goes only if another row of its
    component stays. Rows without shingles link with nothing, so each of them stays."""
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = rows.filter("doc_id IS NOT NULL")
    found = near_duplicates(named.select(F.col("_row").alias("doc_id"), "text"), **options)
    linked = F.col("n_shingles") > 0
    kept = (named.select("_row", "doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))
                                                 .cast("binary")).alias("sum"))
            .join(found.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), "_row")
            .groupBy(F.when(linked, F.col("component_id")), F.when(~linked, F.col("_row")))
            .agg(F.min(F.struct("doc_id", "sum", "_row")).alias("first")).select("first._row"))
    return (named.join(kept, "_row", "left_semi").unionByName(rows.filter("doc_id IS NULL"))
            .drop("_row"))
