"""DuckDB SQL for the queries of operators 11 to 13, by other ways than the operators'."""

from __future__ import annotations

# The tables' pages mark their article; the text is what its markup leaves.
HTML_EXTRACTION = r"""
        WITH bodies AS (
            SELECT page_id, url, regexp_replace(regexp_replace(
                       regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'),
                       '</?(h1|p|br)>', ' ', 'g'), '</?b>', '', 'g') AS body FROM pages),
        decoded AS (
            SELECT page_id, url, trim(regexp_replace(
                       replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'),
                               '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'),
                       '[\s\x0b]+', ' ', 'g')) AS text FROM bodies)
        SELECT page_id, url, text, length(text) AS n_chars FROM decoded"""

# Checksums bit by bit, near words by equal deletions, roots by recursion.
SPELLING_VARIANTS = r"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
            FROM documents),
        marked AS (
            SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bits),
                       lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) AS h
            FROM (SELECT run, n, list_transform(range(0, 4 * length(digits)), lambda i:
                       ((strpos('0123456789ABCDEF', substr(digits, (i // 8 * 2
                           + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END)::BIGINT, 1)) - 1)
                        >> (i % 4)::BIGINT) & 1) AS bits
                  FROM (SELECT run, n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS digits
                        FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL)))),
        words AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT)
                           || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM marked)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS (
            SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut
            FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
        near AS (
            SELECT x.word, y.word AS other, y.n AS m FROM cuts x JOIN cuts y
                ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
            UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.cut = y.word
            UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.cut = y.word),
        tops AS (
            SELECT word, count(*) AS n_near, max(m) AS m,
                   arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
        forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN m >= 5 * n THEN other END AS form,
                   CASE WHEN m >= 5 * n THEN m END AS form_n
            FROM words LEFT JOIN tops USING (word)),
        paths AS (
            SELECT word, word AS here FROM forms
            UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.here
                      WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, p.here AS root, f.n, f.n_near, f.form_n
        FROM forms f JOIN paths p ON p.word = f.word
        JOIN forms e ON e.word = p.here AND e.form IS NULL"""


def lloyd(k: int, rounds: int) -> str:
    """Plain rounds: all distances, nearest centroid, means rounded down."""
    steps = [f"""
        WITH kept AS (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = 64
                AND len(list_filter(embedding::DOUBLE[],
                        lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (
            SELECT row_number() OVER (ORDER BY mark, v) - 1 AS cluster, v AS c
            FROM (SELECT sha256('1:' || vec_id) AS mark, v FROM kept
                  WHERE vec_id IS NOT NULL ORDER BY mark, v LIMIT {k}))"""]
    for at in range(rounds + 1):
        steps.append(f"""
        a{at} AS (
            SELECT row, vec_id, v, cluster, d FROM (
                SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c),
                           lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
                FROM kept CROSS JOIN c{at})
            QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1)""")
        if at < rounds:
            steps.append(f"""
        c{at + 1} AS (
            SELECT cluster, coalesce(mean, c) AS c FROM c{at} LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM (
                    SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n
                    FROM a{at}, unnest(range(1, 65)) AS t(i) GROUP BY cluster, i)
                GROUP BY cluster) USING (cluster))""")
    return ",".join(steps) + f"""
        SELECT vec_id, cluster::INT AS cluster, d AS distance,
               (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = {"op11_html_extraction": HTML_EXTRACTION, "op12_spelling_variants": SPELLING_VARIANTS,
          "op13_centroid_clustering": lloyd(16, 3)}
