"""The results of the queries in SQL, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _vector_codes(rounds: int = 2) -> str:
    """Full searches of the codebooks, and their means, for each round."""
    ctes = [
        """rows_ AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row_id, vec_id, label,
                   list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cells AS MATERIALIZED (
            SELECT row_id, part, x[part * len(x) // 16 + 1:(part + 1) * len(x) // 16] AS y
            FROM (SELECT row_id, x, unnest(range(16)) AS part FROM rows_)
        ), book0 AS MATERIALIZED (SELECT part, row_id AS entry, y AS e FROM cells WHERE row_id < 64)"""
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        ctes.append(
            f"""near{k} AS MATERIALIZED (
            SELECT row_id, part, min(struct_pack(d := {distance}, entry := entry)) AS best
            FROM cells JOIN book{k} USING (part) GROUP BY row_id, part
        )"""
        )
        if k < rounds:
            ctes.append(
                f"""means{k} AS (
            SELECT part, entry, list(mean ORDER BY place) AS mean
            FROM (
                SELECT part, entry, place, floor(sum(y)::HUGEINT / count(*))::BIGINT AS mean
                FROM (
                    SELECT part, n.best.entry AS entry, unnest(range(len(y))) AS place, unnest(y) AS y
                    FROM near{k} n JOIN cells USING (row_id, part)
                ) GROUP BY part, entry, place
            ) GROUP BY part, entry
        ), book{k + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(mean, e) AS e FROM book{k} LEFT JOIN means{k} USING (part, entry)
        )"""
            )
    return f"""
        WITH {", ".join(ctes)}, coded AS (
            SELECT row_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
            FROM near{rounds} GROUP BY row_id
        ), books AS (
            SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM coded JOIN rows_ USING (row_id), books
    """


ORACLE: dict[str, str] = {
    "op2_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x,
                   sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size
            FROM embeddings
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) / (q.size * c.size) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                   vec_id, score
            FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    # sets of shingles, links between distinct sets, and what links lead to
    "op5_ngram_jaccard_join": rf"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), placed AS (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM worded WHERE len(w) > 0
        ), grams AS (
            SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS gram FROM placed
        ), sets AS (
            SELECT doc_id, list(gram ORDER BY gram) AS grams FROM grams GROUP BY doc_id
        ), classes AS MATERIALIZED (
            SELECT grams, min(doc_id) AS node, len(grams) AS n FROM sets GROUP BY grams
        ), cells AS MATERIALIZED (
            SELECT node, n, unnest(grams) AS gram FROM classes
        ), links AS MATERIALIZED (
            SELECT a.node AS a, b.node AS b
            FROM cells a JOIN cells b ON a.gram = b.gram AND a.node <> b.node
            GROUP BY a.node, a.n, b.node, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reached (node, other) AS (
            SELECT node, node FROM classes
            UNION
            SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other
        ), named AS (
            SELECT node, min(other) AS component FROM reached GROUP BY node
        )
        SELECT d.doc_id, coalesce(len(s.grams), 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id
        FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id
        LEFT JOIN classes c ON c.grams = s.grams LEFT JOIN named m ON m.node = c.node
    """,
    # windows of the items, looked up at every word of every document
    "op9_benchmark_decontamination": rf"""
        WITH worded AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, doc_id,
                   regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), placed AS (
            SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k
            FROM items WHERE len(w) > 0
        ), windows AS MATERIALIZED (
            SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM placed
        ), starts AS (
            SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
            FROM worded, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
        ), found AS MATERIALIZED (
            SELECT s.row_id, s.k, s.n, i.item_id
            FROM (SELECT row_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM starts) s
            JOIN windows i USING (n, words)
        ), covered AS (
            SELECT row_id, count(DISTINCT word) AS n_hit
            FROM (SELECT row_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY row_id
        ), matched AS (
            SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found) GROUP BY row_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM worded LEFT JOIN covered USING (row_id) LEFT JOIN matched USING (row_id)
    """,
    # every string of 100 bytes, as digits: two to a byte
    "op11_suffix_dedup": """
        WITH texts AS MATERIALIZED (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s
            FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS p FROM texts)
        ), firsts AS MATERIALIZED (
            SELECT s, min(struct_pack(doc_id := doc_id, p := p)) AS f FROM strings GROUP BY s HAVING count(*) > 1
        ), later AS MATERIALIZED (
            SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE struct_pack(doc_id := doc_id, p := p) > f
        ), runs AS (
            SELECT doc_id, min(p) AS a, max(p) + 100 AS b
            FROM (
                SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
                FROM (
                    SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -999) + 100)::INTEGER AS fresh
                    FROM later
                )
            ) GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
            UNION ALL
            SELECT doc_id, coalesce(max(r.b), 0), max(len(h) // 2) FROM texts LEFT JOIN runs r USING (doc_id) GROUP BY doc_id
        ), cut AS (
            SELECT doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS kept
            FROM texts JOIN gaps g USING (doc_id) GROUP BY doc_id
        ), counted AS (
            SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
        )
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
               coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM texts LEFT JOIN counted USING (doc_id) JOIN cut USING (doc_id)
    """,
    # all products of anchors and rows
    "op12_hard_negatives": """
        WITH v AS MATERIALIZED (
            SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                   list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_dot_product(a.x, c.x)::BIGINT AS score
            FROM v a JOIN v c ON c.vec_id <> a.vec_id
            WHERE a.vec_id % 50 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM pairs WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), negatives AS (
            SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
            FROM positives p JOIN pairs n USING (anchor_id)
            WHERE NOT n.alike AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
    """,
    "op13_vector_codes": _vector_codes(),
}
