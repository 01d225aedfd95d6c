"""DuckDB SQL for the operators that SQL can express."""

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT min(doc_id) AS doc_id, md5(text) AS content_hash, count(*) AS n_copies
        FROM documents GROUP BY text, CASE WHEN text IS NULL THEN doc_id END
    """,
    "op5_topk_search": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
        n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM d),
        q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM benchmark),
        tf AS (SELECT doc_id, len AS size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
        df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
        impact AS (
            SELECT doc_id, word, CAST(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / average))) * 1000000 + 0.5) AS BIGINT) AS impact
            FROM tf JOIN df USING (word), n
        ),
        s AS (SELECT item_id AS query_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN impact USING (word) GROUP BY ALL)
        SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
    """,
    # n-grams, pairs by shared n-gram, and the classes by the closure of the pairs
    "op4_jaccard_join": """
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
        u AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)),
        e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
        SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM c WHERE x = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM e WHERE x = doc_id) AS n_links FROM documents
    """,
}
