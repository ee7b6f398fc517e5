"""What several queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import one_spaced
from quarrymill.operators.index import latest
from quarrymill.session import table

TOP_K, MULTIPLIER = 10, 4

BLANK = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_terms(x: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all(regexp_replace({x}, '({HAN}+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda r: CASE WHEN regexp_matches(r, '^{HAN}') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [lower(r)] END))"
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results that count, each once, with the query in one spelling (`asked`)."""
    score = F.col("score")
    kept = table(spark, sf_dir, "search_results").where(F.col("query").isNotNull() & F.col("source").isNotNull() & score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    return kept.select("result_id", one_spaced(F.col("query")).alias("asked"), "source", "chunk_index", "score").distinct()


RESULTS = rf"""results AS (
    SELECT DISTINCT result_id, {sql_strip(f"regexp_replace(lower(query), '{BLANK}+', ' ', 'g')")} AS asked, source, chunk_index, score
    FROM search_results WHERE query IS NOT NULL AND source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)
)"""


def candidates(spark: SparkSession, sf_dir: str, multiplier: int = MULTIPLIER) -> DataFrame:
    """The results with their chunk's text, the first TOP_K * multiplier of each query; texts join by the chunk's id when the ranks are known."""
    from quarrymill.operators.retrieve import recalled

    chunks = table(spark, sf_dir, "kb_chunks")
    newest = latest(chunks.select("chunk_id", "source", "chunk_index", "indexed_at")).select("source", "chunk_index", "chunk_id")
    there = results(spark, sf_dir).join(newest, ["source", "chunk_index"])
    return recalled(there, "asked", TOP_K, multiplier).join(chunks.select("chunk_id", "text"), "chunk_id").drop("chunk_id")


CANDIDATES = rf"""{RESULTS}, newest AS (
    SELECT source, chunk_index, text FROM kb_chunks
    QUALIFY row_number() OVER (PARTITION BY source, chunk_index ORDER BY indexed_at DESC, chunk_id DESC) = 1
), cand AS (
    SELECT * FROM (
        SELECT r.*, n.text, row_number() OVER (PARTITION BY asked ORDER BY score DESC, source, chunk_index, result_id) AS vector_rank
        FROM results r JOIN newest n USING (source, chunk_index)
    ) WHERE vector_rank <= {TOP_K * MULTIPLIER}
)"""

BM25 = rf"""words AS (
    SELECT result_id, asked, {sql_terms("text")} AS terms, list_distinct({sql_terms("asked")}) AS asked_terms FROM cand
), whole AS (
    SELECT asked, count(*) AS n, avg(len(terms)) AS average FROM words GROUP BY asked
), met AS (
    SELECT result_id, asked, len(terms) AS dl, terms, unnest(asked_terms) AS term FROM words
), tf AS (
    SELECT result_id, asked, dl, term, len(list_filter(terms, lambda x: x = term)) AS tf FROM met WHERE list_contains(terms, term)
), df AS (
    SELECT asked, term, count(*) AS df FROM tf GROUP BY asked, term
), part AS (
    SELECT result_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
        / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (CASE WHEN average > 0 THEN average ELSE 1 END)))) AS bm25
    FROM tf JOIN df USING (asked, term) JOIN whole USING (asked) GROUP BY result_id
), scored AS (
    SELECT c.*, coalesce(p.bm25, 0) AS bm25 FROM cand c LEFT JOIN part p USING (result_id)
)"""


RESCORED = f"""pairs AS (
    SELECT *, list_distinct({sql_terms('asked')}) AS x, list_distinct({sql_terms('text')}) AS y FROM fused
), rescored AS (
    SELECT *, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) ELSE 0 END AS rescore FROM pairs
)"""


def sql_fused(alpha: str) -> str:
    return rf"""fused AS (
    SELECT *, row_number() OVER (PARTITION BY asked ORDER BY fused DESC, vector_rank) AS fused_rank FROM (
        SELECT *, round(CASE WHEN max(bm25) OVER (PARTITION BY asked) <= 0 THEN score
            ELSE ({alpha}) * bm25 / max(bm25) OVER (PARTITION BY asked) + (1 - ({alpha})) * score END, 9) AS fused FROM scored)
)"""
