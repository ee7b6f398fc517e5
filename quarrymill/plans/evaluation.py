"""Queries on how well the rankings find the relevant files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import one_spaced
from quarrymill.operators import bm25, evaluate, retrieve
from quarrymill.plans.shared import BM25, CANDIDATES, RESCORED, RESULTS, BLANK, TOP_K, candidates, results, sql_fused, sql_strip
from quarrymill.session import table

ALPHAS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0)
RESAMPLES = 10_000


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.lower(F.trim("query_type")), F.lit("unknown"))
    return table(spark, sf_dir, "eval_queries").select("qid", one_spaced(F.col("query")).alias("asked"), "relevant_source", kind.alias("kind"))


def _vector_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = results(spark, sf_dir).withColumn("n", F.row_number().over(retrieve.best_first("asked")))
    questions = _questions(spark, sf_dir)
    hits = ranked.join(questions.select("qid", "asked"), "asked")
    return questions.select("qid", "kind").join(evaluate.ranks(questions, hits, "qid", "relevant_source", "n", "source", TOP_K), "qid")


def _both_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieve.fused(candidates(spark, sf_dir), "asked", "asked", F.lit(0.5))
    return evaluate.rankings(_questions(spark, sf_dir), fused, ["qid", "kind"], "asked", "relevant_source", {"rank_a": "vector_rank", "rank_b": "fused_rank"}, "source", TOP_K)


def _three_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = candidates(spark, sf_dir).withColumn("rescore", F.round(retrieve.jaccard(F.col("asked"), F.col("text")), 9))
    order = retrieve.Window.partitionBy("asked").orderBy(F.desc("rescore"), "fused_rank")
    ranked = retrieve.fused(scored, "asked", "asked", F.lit(0.5)).withColumn("final_rank", F.row_number().over(order))
    names = {"rank_a": "vector_rank", "rank_b": "fused_rank", "rank_c": "final_rank"}
    return evaluate.rankings(_questions(spark, sf_dir), ranked, ["qid", "kind"], "asked", "relevant_source", names, "source", TOP_K)


def rank_of_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_ranked(spark, sf_dir)


def mrr_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quality(_vector_ranked(spark, sf_dir), "kind")


def rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distribution(_vector_ranked(spark, sf_dir))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the relevant file by recall alone, by fusion, and by re-scoring the fused candidates."""
    return _three_ranked(spark, sf_dir)


def rr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spread(_vector_ranked(spark, sf_dir))


def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of question and all of them: intervals of both rankings and of their difference, from the same draws."""
    a, b = evaluate.reciprocal(F.col("rank_a")), evaluate.reciprocal(F.col("rank_b"))
    rows = _both_ranked(spark, sf_dir).select("qid", "kind", a.alias("baseline"), b.alias("hybrid"), (b - a).alias("delta"))
    return evaluate.stratified(rows, "qid", "kind", ["baseline", "hybrid", "delta"], RESAMPLES)


def rr_delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.deltas(_both_ranked(spark, sf_dir))


def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.effect(_both_ranked(spark, sf_dir))


def normal_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.normal_interval(_vector_ranked(spark, sf_dir))


def _mean_interval(spark: SparkSession, sf_dir: str, resamples: int) -> DataFrame:
    rows = _vector_ranked(spark, sf_dir).select("qid", evaluate.reciprocal(F.col("rank")).alias("rr"))
    return evaluate.bootstrap(rows, "qid", "rr", resamples)


def _delta_interval(spark: SparkSession, sf_dir: str, resamples: int) -> DataFrame:
    """Both rankings share each question's draws, as their difference is what is drawn."""
    rows = _both_ranked(spark, sf_dir).select("qid", (evaluate.reciprocal(F.col("rank_b")) - evaluate.reciprocal(F.col("rank_a"))).alias("delta"))
    return evaluate.bootstrap(rows, "qid", "delta", resamples)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of the resamples of bootstrap_ci_10000."""
    return _mean_interval(spark, sf_dir, 200)


def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of the resamples of paired_bootstrap_ci_10000."""
    return _delta_interval(spark, sf_dir, 200)


def bootstrap_ci_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean_interval(spark, sf_dir, RESAMPLES)


def paired_bootstrap_ci_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta_interval(spark, sf_dir, RESAMPLES)


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates are scored once, and each weight ranks them anew, all partitioned by the query as the scores were."""
    scored = bm25.candidate_scores(candidates(spark, sf_dir), "asked", "asked", "result_id", "text")
    mixed = [retrieve.mixed_score(F.lit(a), "asked") for a in ALPHAS]
    ranks = [F.row_number().over(retrieve.Window.partitionBy("asked").orderBy(m.desc(), "vector_rank")) for m in [F.col(f"mixed_{i}") for i in range(len(ALPHAS))]]
    ranked = scored.select("*", *[m.alias(f"mixed_{i}") for i, m in enumerate(mixed)]).select("asked", F.col("source").alias("relevant_source"), *[r.alias(f"n_{i}") for i, r in enumerate(ranks)])
    best = ranked.groupBy("asked", "relevant_source").agg(*[F.min(f"n_{i}").alias(f"n_{i}") for i in range(len(ALPHAS))])
    met = _questions(spark, sf_dir).join(best, ["asked", "relevant_source"], "left")
    rank = lambda i: F.when(F.col(f"n_{i}") <= TOP_K, F.col(f"n_{i}") - 1).otherwise(-1)
    best = met.select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), rank(i).alias("rank")) for i, a in enumerate(ALPHAS)])).alias("x")).select("x.alpha", "x.rank")
    return best.groupBy("alpha").agg(F.round(F.avg(evaluate.reciprocal(F.col("rank"))), 6).alias("mrr"), F.round(F.avg((F.col("rank") >= 0).cast("double")), 6).alias("recall"))


def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


def best_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).orderBy(F.desc("mrr"), "alpha").limit(1).select("alpha", "mrr")


def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the results by score, pivoted for each month of retrieval; A and B pass."""
    rows = table(spark, sf_dir, "search_results").where("score is not null and not isnan(score)")
    grade = F.when(F.col("score") >= 0.7, "A").when(F.col("score") >= 0.5, "B").otherwise("C")
    wide = rows.select(F.month("retrieved_at").alias("month"), grade.alias("grade")).groupBy("month").pivot("grade", ["A", "B", "C"]).count().na.fill(0)
    return wide.withColumn("passed", F.col("A") + F.col("B"))


_QUESTIONS = rf"""questions AS (
    SELECT qid, {sql_strip(f"regexp_replace(lower(query), '{BLANK}+', ' ', 'g')")} AS asked, relevant_source, coalesce(lower(trim(query_type)), 'unknown') AS kind FROM eval_queries
)"""
_VECTOR = f"""WITH {RESULTS}, {_QUESTIONS}, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, source, chunk_index, result_id) AS n FROM results
), ev AS (
    SELECT q.qid, q.kind, coalesce(min(r.n) - 1, -1)::INT AS rank FROM questions q LEFT JOIN ranked r ON r.asked = q.asked AND r.source = q.relevant_source AND r.n <= {TOP_K} GROUP BY ALL
), rr AS (SELECT *, CASE WHEN rank >= 0 THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END AS rr FROM ev)"""
_BOTH = f"""WITH {CANDIDATES}, {BM25}, {sql_fused("0.5::DOUBLE")}, {_QUESTIONS}, ev AS (
    SELECT q.qid, q.kind, coalesce(min(f.vector_rank) FILTER (WHERE f.vector_rank <= {TOP_K}) - 1, -1)::INT AS rank_a, coalesce(min(f.fused_rank) FILTER (WHERE f.fused_rank <= {TOP_K}) - 1, -1)::INT AS rank_b
    FROM questions q LEFT JOIN fused f ON f.asked = q.asked AND f.source = q.relevant_source GROUP BY ALL
), rr AS (SELECT *, CASE WHEN rank_a >= 0 THEN 1.0::DOUBLE / (rank_a + 1) ELSE 0 END AS a, CASE WHEN rank_b >= 0 THEN 1.0::DOUBLE / (rank_b + 1) ELSE 0 END AS b FROM ev)"""


def _draws_sql() -> str:
    return " + ".join(f"(u >= {p}::DOUBLE)::INT" for p in evaluate.POISSON)


def _bootstrap_sql(value: str, resamples: int = 200) -> str:
    draws = _draws_sql()
    return f"""drawn AS (
        SELECT resample, v, {draws} AS w FROM (SELECT resample, {value} AS v, ('0x' || substr(md5(resample || '-' || qid), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM rr, range({resamples}) t(resample))
    ), means AS (SELECT resample, sum(w * v) / sum(w) AS mean FROM drawn GROUP BY resample)
    SELECT count(*) AS resamples, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM means"""


_SWEEP = f"""WITH {CANDIDATES}, {BM25}, {_QUESTIONS}, alphas AS (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}]) AS alpha), mixed AS (
    SELECT alpha, s.*, round(CASE WHEN max(bm25) OVER (PARTITION BY alpha, asked) <= 0 THEN score ELSE alpha * bm25 / max(bm25) OVER (PARTITION BY alpha, asked) + (1 - alpha) * score END, 9) AS mixed FROM scored s, alphas
), ranked AS (SELECT *, row_number() OVER (PARTITION BY alpha, asked ORDER BY mixed DESC, vector_rank) AS n FROM mixed), ev AS (
    SELECT a.alpha, q.qid, coalesce(min(r.n) - 1, -1) AS rank FROM questions q CROSS JOIN alphas a
    LEFT JOIN ranked r ON r.alpha = a.alpha AND r.asked = q.asked AND r.source = q.relevant_source AND r.n <= {TOP_K} GROUP BY ALL
), sweep AS (SELECT alpha, round(avg(CASE WHEN rank >= 0 THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END), 6) AS mrr, round(avg((rank >= 0)::INT::DOUBLE), 6) AS recall FROM ev GROUP BY alpha)"""

QUERIES = {
    "rank_of_relevant": rank_of_relevant, "mrr_by_type": mrr_by_type, "rank_distribution": rank_distribution, "strategies": strategies, "rr_delta_counts": rr_delta_counts,
    "effect_size": effect_size, "normal_ci": normal_ci, "bootstrap_ci": bootstrap_ci, "paired_bootstrap_ci": paired_bootstrap_ci, "bootstrap_ci_10000": bootstrap_ci_10000,
    "paired_bootstrap_ci_10000": paired_bootstrap_ci_10000, "alpha_sweep": alpha_sweep,
    "best_alpha": best_alpha, "grade_counts": grade_counts, "rr_summary": rr_summary, "stratified_bootstrap": stratified_bootstrap,
}

SQL = {
    "rank_of_relevant": f"{_VECTOR} SELECT qid, kind, rank FROM ev",
    "mrr_by_type": f"{_VECTOR} SELECT kind, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg((rank >= 0)::INT::DOUBLE), 6) AS recall FROM rr GROUP BY ROLLUP (kind)",
    "rank_distribution": f"""{_VECTOR} SELECT count(*) AS n, round(avg(rank), 6) AS mean, quantile_cont(rank, 0.5)::DOUBLE AS median, min(rank) AS least, max(rank) AS most,
        count(*) FILTER (WHERE rank < 1) AS top1, count(*) FILTER (WHERE rank < 5) AS top5, count(*) FILTER (WHERE rank < 10) AS top10 FROM ev WHERE rank >= 0""",
    "strategies": f"""WITH {CANDIDATES}, {BM25}, {sql_fused('0.5::DOUBLE')}, {_QUESTIONS}, {RESCORED}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY asked ORDER BY rescore DESC, fused_rank) AS final_rank FROM rescored)
    SELECT q.qid, q.kind, coalesce(min(f.vector_rank) FILTER (WHERE f.vector_rank <= {TOP_K}) - 1, -1)::INT AS rank_a, coalesce(min(f.fused_rank) FILTER (WHERE f.fused_rank <= {TOP_K}) - 1, -1)::INT AS rank_b,
        coalesce(min(f.final_rank) FILTER (WHERE f.final_rank <= {TOP_K}) - 1, -1)::INT AS rank_c
    FROM questions q LEFT JOIN ranked f ON f.asked = q.asked AND f.source = q.relevant_source GROUP BY ALL""",
    "rr_summary": f"""{_VECTOR} SELECT count(*) AS n, round(avg(rr), 6) AS mean, round(stddev_samp(rr), 6) AS sd, round(var_samp(rr), 6) AS variance, round(quantile_cont(rr, 0.5), 6) AS median, round(max(rr), 6) AS most,
        count(*) FILTER (WHERE rr > 0) AS non_zero FROM rr""",
    "stratified_bootstrap": f"""{_BOTH}, drawn AS (
        SELECT resample, kind, a, b, {_draws_sql()} AS w FROM (SELECT resample, kind, a, b, ('0x' || substr(md5(resample || '-' || qid), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM rr, range({RESAMPLES}) t(resample))
    ), means AS (SELECT kind, resample, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b, sum(w * (b - a)) / sum(w) AS d FROM drawn GROUP BY GROUPING SETS ((kind, resample), (resample)))
    SELECT kind, round(quantile_cont(a, 0.025), 6) AS baseline_low, round(quantile_cont(a, 0.975), 6) AS baseline_high, round(quantile_cont(b, 0.025), 6) AS hybrid_low, round(quantile_cont(b, 0.975), 6) AS hybrid_high,
        round(quantile_cont(d, 0.025), 6) AS delta_low, round(quantile_cont(d, 0.975), 6) AS delta_high FROM means WHERE NOT isnan(a) GROUP BY kind""",
    "rr_delta_counts": f"""{_BOTH} SELECT count(*) FILTER (WHERE b > a) AS better, count(*) FILTER (WHERE b < a) AS worse, count(*) FILTER (WHERE a = b) AS alike,
        count(*) FILTER (WHERE rank_a < 0 AND rank_b < 0) AS both_missed FROM rr""",
    "effect_size": f"""{_BOTH}, base AS (SELECT avg(a) AS a, avg(b) AS b, sqrt((var_samp(a) + var_samp(b)) / 2) AS pooled FROM rr), d AS (SELECT *, CASE WHEN pooled > 0 THEN (b - a) / pooled ELSE 0 END AS d FROM base)
        SELECT round(b - a, 6) AS delta, round(d, 6) AS cohens_d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label,
            round(CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 'inf'::DOUBLE END, 4) AS lift_percent FROM d""",
    "normal_ci": f"""{_VECTOR}, base AS (SELECT avg(rr) AS m, 1.96::DOUBLE * stddev_samp(rr) / sqrt(count(*)) AS wide FROM rr)
        SELECT round(m, 6) AS mrr, round(greatest(0, m - wide), 6) AS low, round(least(1, m + wide), 6) AS high FROM base""",
    "bootstrap_ci": f"{_VECTOR}, {_bootstrap_sql('rr')}",
    "paired_bootstrap_ci": f"{_BOTH}, {_bootstrap_sql('b - a')}",
    "bootstrap_ci_10000": f"{_VECTOR}, {_bootstrap_sql('rr', RESAMPLES)}",
    "paired_bootstrap_ci_10000": f"{_BOTH}, {_bootstrap_sql('b - a', RESAMPLES)}",
    "alpha_sweep": f"{_SWEEP} SELECT alpha, mrr, recall FROM sweep",
    "best_alpha": f"{_SWEEP} SELECT alpha, mrr FROM sweep ORDER BY mrr DESC, alpha LIMIT 1",
    "grade_counts": """WITH g AS (SELECT month(retrieved_at)::INT AS month, CASE WHEN score >= 0.7 THEN 'A' WHEN score >= 0.5 THEN 'B' ELSE 'C' END AS grade FROM search_results WHERE score IS NOT NULL AND NOT isnan(score))
        SELECT month, count(*) FILTER (WHERE grade = 'A') AS "A", count(*) FILTER (WHERE grade = 'B') AS "B", count(*) FILTER (WHERE grade = 'C') AS "C", count(*) FILTER (WHERE grade <> 'C') AS passed FROM g GROUP BY month""",
}
