"""Queries on terms, vectors, fusion and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.config import Retrieval
from quarrymill.functions.text import terms, token_estimate
from quarrymill.functions.vectors import norm
from quarrymill.operators import bm25, retrieve
from quarrymill.plans.shared import BM25, CANDIDATES, RESCORED, TOP_K, candidates, results, RESULTS, sql_fused, sql_terms
from quarrymill.session import spread, table

CONTEXT_TOKENS = Retrieval().context_tokens


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "kb_chunks").select("chunk_id", terms(F.col("text")).alias("t"))
    return words.select("chunk_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequency(table(spark, sf_dir, "kb_chunks"), "chunk_id", "text")


def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.statistics(table(spark, sf_dir, "kb_chunks"), "chunk_id", "text").select("n", F.round("average", 6).alias("average"))


def asked_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100."""
    return table(spark, sf_dir, "eval_queries").where(F.col("qid") % 100 == 0)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spread(table(spark, sf_dir, "kb_chunks").select("chunk_id", "text"))
    found = bm25.scores(asked_queries(spark, sf_dir), "qid", "query", chunks, "chunk_id", "text")
    rounded = found.withColumn("score", F.round("score", 6))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return rounded.withColumn("rank_no", F.row_number().over(best)).where("rank_no <= 5").select("qid", "rank_no", "chunk_id", "score")


def bm25_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.candidate_scores(candidates(spark, sf_dir), "asked", "asked", "result_id", "text")
    return found.select("result_id", F.round("bm25", 6).alias("bm25"))


def overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("result_id", "vector_rank")


def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.fused(candidates(spark, sf_dir), "asked", "asked", F.lit(0.5))
    return found.where(F.col("fused_rank") <= TOP_K).select("result_id", "fused_rank", F.round("fused", 6).alias("fused"))


def adaptive_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.fused(candidates(spark, sf_dir), "asked", "asked", retrieve.length_alpha(F.col("asked")))
    return found.where(F.col("fused_rank") <= TOP_K).select("result_id", "fused_rank", F.round("fused", 6).alias("fused"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that a text shares with its query are counted where the text is, and only the score moves on."""
    scored = candidates(spark, sf_dir).withColumn("rescore", F.round(retrieve.jaccard(F.col("asked"), F.col("text")), 9))
    found = retrieve.reranked(retrieve.fused(scored, "asked", "asked", F.lit(0.5)), "asked", "fused_rank", TOP_K, lambda c: c)
    return found.select("result_id", "final_rank", F.round("rescore", 6).alias("rescore"))


def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieve.fused(candidates(spark, sf_dir), "asked", "asked", F.lit(0.5))
    return retrieve.reranked(fused, "asked", "fused_rank", TOP_K, None).select("result_id", "final_rank")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieve.cosine_top_k(vectors.where("id % 100 = 0"), vectors, 5)


def vector_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    vectors = every.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = retrieve.cosine_top_k(vectors.where("id % 100 = 0"), vectors, 10)
    own = found.join(every.select(F.col("vec_id").alias("id"), "label"), "id").join(every.select(F.col("vec_id").alias("other"), F.col("label").alias("label_b")), "other")
    return own.groupBy("id").agg(F.round(F.avg((F.col("label") == F.col("label_b")).cast("double")), 6).alias("same_label"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_vectors").where("vec is not null and not exists(vec, x -> x is null or isnan(x))").select("vec_id", F.size("vec").alias("n"), F.round(norm(F.col("vec")), 4).alias("norm"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.hashed_embedding(table(spark, sf_dir, "eval_queries"), "qid", "query")


def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kb_chunks").select("chunk_id", token_estimate(F.col("text")).alias("tokens"))


def _within(spark: SparkSession, sf_dir: str, tokens: int) -> DataFrame:
    return retrieve.within_budget(candidates(spark, sf_dir, 1), "asked", "vector_rank", tokens)


def _prompts(kept: DataFrame) -> DataFrame:
    return retrieve.prompts(kept, "asked", "vector_rank").select("asked", F.md5("context").alias("digest"), F.length("context").alias("n_chars"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(spark, sf_dir, 800).select("result_id", "tokens", "used")


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(_within(spark, sf_dir, 800))


def context_budget_4000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(spark, sf_dir, CONTEXT_TOKENS).select("result_id", "tokens", "used")


def prompt_context_4000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(_within(spark, sf_dir, CONTEXT_TOKENS))


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = results(spark, sf_dir).withColumn("n", F.row_number().over(retrieve.best_first("asked"))).where("n <= 5")
    return first.groupBy("asked").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


_TOPK_SQL = rf"""
WITH words AS (SELECT chunk_id, {sql_terms("text")} AS terms FROM kb_chunks),
asked AS (SELECT qid, unnest(list_distinct({sql_terms("query")})) AS term FROM eval_queries WHERE qid % 100 = 0),
whole AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM words),
tf AS (SELECT chunk_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, terms, unnest(terms) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
found AS (
    SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average))), 6) AS score
    FROM tf JOIN df USING (term) JOIN asked USING (term), whole GROUP BY qid, chunk_id
)
SELECT qid, rank_no, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank_no FROM found) WHERE rank_no <= 5
"""

_COSINE = """
pairs AS (
    SELECT a.vec_id AS id, b.vec_id AS other, a.label AS label, b.label AS label_b,
        round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
            / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other)::INT AS rank_no FROM pairs)"""


def _fused_sql(alpha: str, select: str, rank: str = "fused_rank") -> str:
    return f"WITH {CANDIDATES}, {BM25}, {sql_fused(alpha)} {select} FROM fused WHERE {rank} <= {TOP_K}"


_FUSED = "SELECT result_id, fused_rank::INT AS fused_rank, round(fused, 6) AS fused"
_PIECE = "'[来源: ' || source || ']' || chr(10) || text"


def _budget_sql(tokens: int) -> str:
    return f"""kept AS (
    SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY asked ORDER BY vector_rank) AS used FROM (
        SELECT *, {_PIECE} AS piece, greatest(1, strlen({_PIECE}) // 3) AS tokens FROM cand WHERE vector_rank <= {TOP_K})) WHERE vector_rank = 1 OR used <= {tokens}
)"""


_BUDGET = _budget_sql(800)
_BUDGET_4000 = _budget_sql(CONTEXT_TOKENS)

QUERIES = {
    "token_counts": token_counts, "term_frequency": term_frequency, "bm25_statistics": bm25_statistics, "bm25_topk": bm25_topk, "bm25_candidates": bm25_candidates,
    "overfetch": overfetch, "hybrid_fuse": hybrid_fuse, "adaptive_alpha": adaptive_alpha, "rerank_topk": rerank_topk, "rerank_fallback": rerank_fallback,
    "vector_topk": vector_topk, "vector_label_recall": vector_label_recall, "vector_norms": vector_norms, "hash_embed": hash_embed, "estimate_tokens": estimate_tokens,
    "context_budget": context_budget, "prompt_context": prompt_context, "context_budget_4000": context_budget_4000, "prompt_context_4000": prompt_context_4000,
    "answer_sources": answer_sources,
}

SQL = {
    "token_counts": f"SELECT chunk_id, len(t)::INT AS n_terms, len(list_distinct(t))::INT AS n_distinct FROM (SELECT chunk_id, {sql_terms('text')} AS t FROM kb_chunks)",
    "term_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_terms('text')})) AS term FROM kb_chunks) GROUP BY term",
    "bm25_statistics": f"SELECT count(*) AS n, round(avg(len({sql_terms('text')})), 6) AS average FROM kb_chunks",
    "bm25_topk": _TOPK_SQL,
    "bm25_candidates": f"WITH {CANDIDATES}, {BM25} SELECT result_id, round(bm25, 6) AS bm25 FROM scored",
    "overfetch": f"WITH {CANDIDATES} SELECT result_id, vector_rank::INT AS vector_rank FROM cand",
    "hybrid_fuse": _fused_sql("0.5::DOUBLE", _FUSED),
    "adaptive_alpha": _fused_sql("CASE WHEN length(asked) <= 12 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END", _FUSED),
    "rerank_topk": f"""WITH {CANDIDATES}, {BM25}, {sql_fused('0.5::DOUBLE')}, {RESCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY rescore DESC, fused_rank)::INT AS final_rank FROM rescored)
    SELECT result_id, final_rank, round(rescore, 6) AS rescore FROM ranked WHERE final_rank <= {TOP_K}""",
    "rerank_fallback": _fused_sql("0.5::DOUBLE", "SELECT result_id, fused_rank::INT AS final_rank"),
    "vector_topk": f"WITH {_COSINE} SELECT id, other, score, rank_no FROM ranked WHERE rank_no <= 5",
    "vector_label_recall": f"WITH {_COSINE} SELECT id, round(avg((label = label_b)::INT::DOUBLE), 6) AS same_label FROM ranked WHERE rank_no <= 10 GROUP BY id",
    "vector_norms": "SELECT vec_id, len(vec)::INT AS n, round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 4) AS norm FROM chunk_vectors WHERE vec IS NOT NULL AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0",
    "hash_embed": f"""WITH words AS (SELECT qid, md5(unnest({sql_terms('query')})) AS h FROM eval_queries), sums AS (
        SELECT qid, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM words GROUP BY ALL HAVING s <> 0)
    SELECT qid, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY qid)), 6) AS weight FROM sums""",
    "estimate_tokens": "SELECT chunk_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, strlen(text) // 3) END::INT AS tokens FROM kb_chunks",
    "context_budget": f"WITH {CANDIDATES}, {_BUDGET} SELECT result_id, tokens::INT AS tokens, used::BIGINT AS used FROM kept",
    "prompt_context": f"""WITH {CANDIDATES}, {_BUDGET}, whole AS (SELECT asked, string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY vector_rank) AS context FROM kept GROUP BY asked)
    SELECT asked, md5(context) AS digest, length(context)::INT AS n_chars FROM whole""",
    "context_budget_4000": f"WITH {CANDIDATES}, {_BUDGET_4000} SELECT result_id, tokens::INT AS tokens, used::BIGINT AS used FROM kept",
    "prompt_context_4000": f"""WITH {CANDIDATES}, {_BUDGET_4000}, whole AS (SELECT asked, string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY vector_rank) AS context FROM kept GROUP BY asked)
    SELECT asked, md5(context) AS digest, length(context)::INT AS n_chars FROM whole""",
    "answer_sources": f"""WITH {RESULTS}, first AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, source, chunk_index, result_id) <= 5)
    SELECT asked, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM first GROUP BY asked""",
}
