"""Grouping of spelling variants (operator 12): asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Of
two words the longer one (of equally long ones the smaller) contributes two disjoint chunks, its
halves; the other contributes positional grams. One edit falls into one of the halves and leaves
the other as a gram of the other word, moved by their difference in length, so by one place at
most. Grams that lie further from a chunk's place than that are not posted, which makes the join
within shift one a join on equal keys.

A half alone is a frequent key ("tion"). The edit cannot touch both pieces of the broken half
either, so a posting carries the chunk together with the first or with the last piece of the rest
of the word: a key then holds about three quarters of a word, and few words share it. Candidates
are verified with the edit distance.

Everything is DataFrame work: words are counted with map-side aggregation, and a posting holds one
distinct word, so a frequent word, line or document makes no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialise, prepare

WORD = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _slipped(doc_id: Column, word: Column, slip: int) -> Column:
    """``word`` without the code point that a checksum of document and word picks, where ``slip``
    divides the checksum."""
    mark = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word),
                            "UTF-8"))
    place = (mark % F.length(word)).cast("int")
    return F.when(mark % slip == 0, F.concat(F.substring(word, F.lit(1), place),
                                             F.substring(word, place + 2, F.length(word)))
                  ).otherwise(word)


def count_words(docs: DataFrame, slip: int | None = None) -> DataFrame:
    """(word, n) of the maximal runs of letters in whole texts, A-Z in lower case. ``docs``:
    doc_id, text. With ``slip``, words whose checksum with their document's id ``slip`` divides
    lose a code point (a null id counts as an empty one); words that are empty then do not count.
    Null texts have no words."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("word"))
    if slip is not None:
        words = words.select(_slipped(F.col("doc_id"), F.col("word"), slip).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _left(word: Column, k: Column) -> Column:
    return F.substring(word, F.lit(1), k)


def _right(word: Column, k: Column) -> Column:
    return F.substring(word, F.length(word) - k + 1, k)


def _postings(words: DataFrame, long: Column) -> Column:
    """Keys of a word as a partner of chunk words of ``long`` code points: the chunk (the first or
    the last half) with the first or the last piece of the rest."""
    word = F.col("word")
    head = F.floor(long / 2).cast("int")
    tail = long - head

    def pieces(chunk: Column, rest: Column, size: Column) -> list[Column]:
        first = F.floor(size / 2).cast("int")
        return [F.struct(F.concat_ws("|", long, F.lit(which), chunk, piece).alias("key"))
                for which, piece in (("first", _left(rest, first)),
                                     ("last", _right(rest, size - first)))]

    front = pieces(F.concat(F.lit("head "), _left(word, head)),
                   _right(word, F.length(word) - head), tail)
    back = pieces(F.concat(F.lit("tail "), _right(word, tail)),
                  _left(word, F.length(word) - tail), head)
    return F.array(*front, *back)


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every unordered pair of distinct words of ``words`` (word, n; distinct
    words of at least four code points) that one edit turns into each other, once."""
    size = F.length("word")
    chunks = words.select("word", "n", F.inline(_postings(words, size)))
    grams = (words.select("word", "n", F.explode(F.array(size, size + 1)).alias("long"))
             .select("word", "n", F.inline(_postings(words, F.col("long")))))
    pairs = (chunks.toDF("a", "na", "key").join(grams.toDF("b", "nb", "key"), "key")
             .filter((F.length("a") > F.length("b")) | (F.col("a") < F.col("b")))
             .filter(F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "na", "b", "nb").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form). A form has a larger count than its
    word, so chains end; rounds grow with the logarithm of the longest chain."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.toDF("mid", "further")
        roots = materialise(
            roots.join(ahead, F.col("root") == F.col("mid"), "left")
            .select("word", F.coalesce("further", "root").alias("root"),
                    F.col("further").isNotNull().alias("moved")), "roots")
        moved = roots.filter("moved").limit(1).count()
        roots = roots.select("word", "root")
        if not moved:
            return roots


def spelling_variants(counts: DataFrame, min_chars: int = 6, min_count: int = 5,
                      ratio: int = 5) -> DataFrame:
    """Groups the words of ``counts`` (word, n; other columns are ignored) that have at least
    ``min_chars`` code points (four or more) and ``min_count`` occurrences. A word's form is its
    near word of largest n (ties: the smallest in code-point order) if that n is at least
    ``ratio`` times its own. Returns one row per word: word, form (null without one), root (the
    last word that forms lead to; the word itself without a form), n, n_near (its near words) and
    form_n. Null words do not count; an empty table gives an empty result."""
    if min_chars < 4:
        raise ValueError("words of fewer than four code points have no two chunks with pieces")
    prepare(counts.sparkSession)
    words = materialise(counts.filter(F.length("word") >= min_chars).filter(F.col("n") >= min_count)
                        .select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = materialise(near_words(words), "near")
    both = pairs.unionByName(pairs.toDF("b", "nb", "a", "na"))
    near = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("nb"), "b")).alias("top"))
    joined = materialise(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("top.nb") >= ratio * F.col("n"), F.col("top.b")).alias("form"),
            F.when(-F.col("top.nb") >= ratio * F.col("n"), -F.col("top.nb")).alias("form_n")),
        "forms")
    roots = _roots(joined.filter("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
