"""Registered queries of this subpackage: each applies one operator, with production parameters,
to its whole table and derives the contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.ann import nearest
from mercato.llm.binary_ids import read_token_files, write_token_files
from mercato.llm.common import table
from mercato.llm.heap_kmeans import cluster_vectors
from mercato.llm.html_extract import extract_main_text
from mercato.llm.line_dedup import dedup_lines
from mercato.llm.minhash import near_duplicates
from mercato.llm.mixing import mix_sources
from mercato.llm.multi_index import near_duplicate_vectors
from mercato.llm.oracles import ORACLE as NEW_ORACLE
from mercato.llm.packing import pack_documents
from mercato.llm.pii import IBAN_BODIES, find_personal_data, span_text
from mercato.llm.spelling import count_words, spelling_variants
from mercato.llm.toxicity import score_toxicity
from mercato.llm.url_filter import Rule, judge_urls

# The contract's rules.
URL_RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"),
             Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"),
             Rule("net", "/fr/", "block")]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in ("email", "ip", "card", "phone")],
        F.sha2(span_text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "text", "replica", "shuffle_key")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_token_files(table(spark, sf_dir, "documents"), end_id=2)
    return read_token_files(spark, written, with_ids=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_chars=20, min_docs=3).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), size=4096, end_id=1)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(count_words(docs, slip=199), min_chars=6, min_count=5, ratio=5)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_source_mixing": op5_source_mixing,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_binary_ids": op7_binary_ids,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_html_extraction": op11_html_extraction,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}

# Vectors that may be compared, for both vector operators.
_USABLE = r"""
        usable AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[],
                      lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0)"""


def _iban_pattern() -> str:
    """IBANs by the length of their country. Codes of no country in the registry may have any
    length; they are listed by first letter, since this dialect cannot look ahead."""
    fixed, other = [], []
    codes = {code: n for n, codes in IBAN_BODIES.items() for code in codes.split()}
    for code, n in sorted(codes.items()):
        fixed.append(f"{code}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for first in letters:
        rest = "".join(x for x in letters if first + x not in codes)
        other.append(f"{first}[{rest}]")
    return rf"\b(?:{'|'.join(fixed)}|(?:{'|'.join(other)})[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})\b"


def _matches(kind: str, rank: int, pattern: str) -> str:
    """SQL for the matches of a pattern with their places, from the pieces between them."""
    return f"""
        SELECT doc_id, '{kind}' AS kind, {rank} AS rank, m, gap, next_gap,
               sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS gap,
                     unnest(gs[2:len(ms) + 1]) AS next_gap,
                     generate_subscripts(ms, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms,
                           string_split_regex(text, '{pattern}') AS gs
                    FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0)
        WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""


ORACLE: dict[str, str] = {
    "op1_personal_data": "WITH proposed AS (" + " UNION ALL ".join([
        _matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        _matches("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
        _matches("card", 2, r"[0-9](?:[\x20-]?[0-9])+"),
        _matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]"),
        _matches("iban", 4, _iban_pattern()),
        _matches("ssn", 5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ]) + r"""),
        measured AS (
            SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d,
                   lower(right(gap, 48) || ' ' || left(next_gap, 48)) AS near,
                   replace(m, ' ', '') AS compact FROM proposed),
        spans AS (
            SELECT doc_id, kind, rank, start::BIGINT AS start, (start + length(m))::BIGINT AS stop
            FROM measured WHERE CASE kind
                WHEN 'email' THEN true
                WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'),
                                        lambda p: p::HUGEINT)) <= 255
                WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(
                    range(1, length(d) + 1), lambda i: CASE
                        WHEN i % 2 = 1 THEN substr(d, (length(d) + 1 - i)::BIGINT, 1)::INT
                        ELSE (2 * substr(d, (length(d) + 1 - i)::BIGINT, 1)::INT) // 10
                           + (2 * substr(d, (length(d) + 1 - i)::BIGINT, 1)::INT) % 10 END)) % 10 = 0
                WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
                WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(
                    string_split(substr(compact, 5) || substr(compact, 1, 4), ''),
                    lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
                    lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
                ELSE regexp_matches(near, 'ssn|social security|tax id|sozialversicherung'
                                    || '|sécurité sociale|seguro social') END),
        joined AS (
            SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email,
                   count(*) FILTER (kind = 'ip') AS n_ip,
                   count(*) FILTER (kind = 'card') AS n_card,
                   count(*) FILTER (kind = 'phone') AS n_phone,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)
                       FILTER (rank < 4) AS base,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
            FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip,
               coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN joined USING (doc_id)""",
    "op2_embedding_near_dedup": "WITH RECURSIVE" + _USABLE + r""",
        links AS (
            SELECT x.vec_id AS a, y.vec_id AS b
            FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
                 AND len(x.e) = len(y.e)
            WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
        reach AS (
            SELECT a AS vec_id, a AS r FROM links
            UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.vec_id
                  WHERE reach.r < l.a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM (SELECT vec_id FROM embeddings)
        LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
        LEFT JOIN (SELECT vec_id, min(r) AS m FROM reach GROUP BY vec_id) USING (vec_id)""",
    "op3_nearest_neighbours": "WITH" + _USABLE + r""",
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT
                   AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5""",
    "op5_source_mixing": r"""
        WITH RECURSIVE sizes AS (
            SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
        rates AS (
            SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5)
                       / (SELECT sum(pow(size, 0.5)) FROM sizes)
                       * (SELECT sum(size) FROM sizes) / size ELSE 1.0 END AS rate FROM sizes),
        split AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS parts FROM rates),
        terms AS (
            SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS cdf,
                   rate / parts AS mean FROM split
            UNION ALL SELECT source, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1), mean
                      FROM terms WHERE k < 96),
        draws AS (
            SELECT doc_id, d.source, lang, text,
                   (('0x' || substr(md5('17|' || doc_id || '|' || part), 1, 13))::BIGINT + 0.5)
                       / 4503599627370496 AS u
            FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source,
                 unnest(range(1, parts + 1)) AS t(part)),
        counted AS (
            SELECT doc_id, d.source, any_value(lang) AS lang, any_value(text) AS text,
                   count(k) AS copies
            FROM draws d LEFT JOIN terms c ON d.source IS NOT DISTINCT FROM c.source AND cdf < u
            GROUP BY doc_id, d.source)
        SELECT doc_id, source, lang, text, replica::INT AS replica,
               substr(md5('order 17|' || doc_id || '|' || replica), 1, 16) AS shuffle_key
        FROM counted, unnest(range(0, copies)) AS t(replica)""",
    "op6_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text,
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
                       ELSE array_to_string(w[i:i+2], ' ') END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i
                  FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
                GROUP BY x.doc_id, y.doc_id) p
            JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
            WHERE 100 * c >= 85 * (sa.n + sb.n - c)),
        reach AS (
            SELECT a AS doc_id, a AS r FROM links
            UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.doc_id
                  WHERE reach.r < l.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
               least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
        FROM documents d LEFT JOIN sizes USING (doc_id)
        LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, n, line,
                   translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
                  FROM documents)),
        shared AS (
            SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (last IS NOT NULL AND last <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n)
                      FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
        FROM lines LEFT JOIN shared USING (key) GROUP BY doc_id""",
    **NEW_ORACLE,
}
