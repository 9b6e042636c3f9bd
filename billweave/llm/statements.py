"""DuckDB statements for the training-data queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY = rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS words, row_number() OVER () AS r FROM documents),
windows AS (
    SELECT r, i, words[i:i + 7] AS w FROM docs, unnest(range(1, len(words) - 6)) AS u(i) WHERE len(words) >= 8
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT r, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n_repeat_words
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r
),
counted AS (
    SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
        len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))))::BIGINT AS n_different,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs LEFT JOIN covered USING (r)
),
based AS (
    SELECT *, n_lines - n_different AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
),
measured AS (
    SELECT *, row_number() OVER () AS r, 1000 * word_chars // nullif(n_words, 0) AS word_length, 1000 * n_symbols // nullif(n_words, 0) AS symbols,
        1000 * n_dup_lines // nullif(n_lines, 0) AS dup_lines, 1000 * n_repeat_words // nullif(n_words, 0) AS repeats
    FROM based
),
each AS (
    SELECT lang, source, measure, v >> greatest(0, length(bin(v)) - 8) << greatest(0, length(bin(v)) - 8) AS bin
    FROM (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats FROM measured WHERE NOT base_failed)
          ON word_length, symbols, dup_lines, repeats INTO NAME measure VALUE v)
),
levels AS (
    SELECT 0 AS level, * FROM each UNION ALL SELECT 1, lang, NULL, measure, bin FROM each UNION ALL SELECT 3, NULL, NULL, measure, bin FROM each
),
placed AS (
    SELECT level, lang, source, measure, bin, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, measure) AS total
    FROM (SELECT level, lang, source, measure, bin, count(*) AS n FROM levels GROUP BY ALL)
),
quartiles AS (
    SELECT level, lang, source, measure, max(total) AS n, min(bin) FILTER (upto * 100 >= total * 25) AS q1,
        min(bin) FILTER (upto * 100 >= total * 50) AS q2, min(bin) FILTER (upto * 100 >= total * 75) AS q3
    FROM placed GROUP BY ALL
),
leasts(measure, least) AS (VALUES ('word_length', 100), ('symbols', 20), ('dup_lines', 70), ('repeats', 40)),
fences AS (
    SELECT level, lang, source, measure, n, q3 + 6 * greatest(least, q3 - q2) AS high,
        CASE WHEN measure = 'word_length' THEN q1 - 6 * greatest(least, q2 - q1) ELSE -1 END AS low
    FROM quartiles JOIN leasts USING (measure)
),
chosen AS (
    SELECT r, m.lang, m.source, coalesce(g.level, l.level, 3) AS level
    FROM measured AS m
    LEFT JOIN (SELECT DISTINCT level, lang, source FROM fences WHERE level = 0 AND n >= 100) AS g
        ON g.lang IS NOT DISTINCT FROM m.lang AND g.source IS NOT DISTINCT FROM m.source
    LEFT JOIN (SELECT DISTINCT level, lang FROM fences WHERE level = 1 AND n >= 100) AS l ON l.lang IS NOT DISTINCT FROM m.lang
),
values_of AS (
    SELECT r, measure, v FROM (UNPIVOT (SELECT r, word_length, symbols, dup_lines, repeats FROM measured)
        ON word_length, symbols, dup_lines, repeats INTO NAME measure VALUE v)
),
kept AS (
    SELECT c.r, bool_and(v BETWEEN f.low AND f.high) AS inside
    FROM chosen AS c JOIN values_of USING (r) JOIN fences AS f ON f.measure = values_of.measure AND f.level = c.level
        AND (c.level = 3 OR f.lang IS NOT DISTINCT FROM c.lang) AND (c.level > 0 OR f.source IS NOT DISTINCT FROM c.source)
    GROUP BY c.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept
FROM measured LEFT JOIN kept USING (r)
"""

REACHED = """
reached(a, b) AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
"""

MINHASH = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, words[i:i + 1] AS s FROM docs, unnest(range(1, greatest(len(words), 2))) AS u(i) WHERE len(words) > 0
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles AS x JOIN shingles AS y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
),
near AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes AS m ON m.doc_id = a JOIN sizes AS n ON n.doc_id = b WHERE 100 * c >= 80 * (m.n + n.n - c)
),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
{REACHED}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id,
    doc_id = least(doc_id, coalesce(least.b, doc_id)) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = doc_id
"""

VECTORS = f"""
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
    SELECT x.vec_id AS a, y.vec_id AS b FROM sound AS x JOIN sound AS y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) >= 0.93
),
{REACHED},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

INFILL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
    FROM documents
),
numbers AS (
    SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM drawn
),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
),
parts AS (
    SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle,
        coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
           ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


TOP_K = """
WITH vectors AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS u, row_number() OVER () AS r FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS candidate,
        coalesce(list_sum(list_transform(range(1, least(len(q.u), len(c.u)) + 1), lambda i: q.u[i] * c.u[i])), 0)::BIGINT AS score
    FROM vectors AS q JOIN vectors AS c ON q.r <> c.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, candidate))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def _nearest(name: str, centroids: str) -> str:
    """A table expression: every kept vector with its nearest centroid."""
    return f"""
{name} AS MATERIALIZED (
    SELECT r, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.u[i] - c.u[i]) * (v.u[i] - c.u[i])))::BIGINT, 'k': c.k}}) AS m
    FROM vectors AS v, {centroids} AS c GROUP BY r
)"""


def _means(name: str, nearest: str, before: str) -> str:
    """A table expression: the centroids of `before`, those with vectors moved to the floor of their mean."""
    return f"""
{name} AS MATERIALIZED (
    SELECT b.k, coalesce(any_value(moved.u), any_value(b.u)) AS u FROM {before} AS b LEFT JOIN (
        SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS u FROM (
            SELECT m.k AS k, i, sum(u[i])::HUGEINT AS s, count(*) AS n FROM {nearest} JOIN vectors USING (r), unnest(range(1, 65)) AS t(i) GROUP BY ALL
        ) GROUP BY k
    ) AS moved USING (k) GROUP BY b.k
)"""


CENTROIDS = f"""
WITH vectors AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS u, row_number() OVER () AS r FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
    SELECT k, u FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), u) - 1 AS k, u FROM vectors) WHERE k < 16
),
{",".join(_nearest(f"a{k}", f"c{k}") + "," + _means(f"c{k + 1}", f"a{k}", f"c{k}") for k in range(3))},
{_nearest("a3", "c3")}
SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia,
    (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.u, ',')) AS centroid_sha256
FROM a3 JOIN vectors USING (r) JOIN c3 ON c3.k = m.k
"""


def statements() -> dict[str, str]:
    return {
        "op2_quality_rules": QUALITY,
        "op4_minhash": MINHASH,
        "op8_embedding_dedup": VECTORS,
        "op11_fill_in_middle": INFILL,
        "op12_top_k": TOP_K,
        "op13_centroids": CENTROIDS,
    }
