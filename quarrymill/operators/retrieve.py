"""Recall by vectors, fusion with BM25, re-scoring, and what of the results goes into a prompt."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.errors import RetrievalError
from quarrymill.functions.text import piece_of_context, terms, token_estimate
from quarrymill.functions.vectors import dot, norm
from quarrymill.operators import bm25


WORST = 3_000_000


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, at_once: int = 20_000) -> DataFrame:
    """id, other, score (6 decimals) and rank_no of the k vectors most like each query (id, vec) among `vectors` (id, vec).

    A query is not compared with the vector of its own id. Tasks hold a slice of `at_once` queries; more queries take
    more passes over the vectors. Each task keeps the k best of all it reads, so that only these are shuffled.
    """
    rows = queries.select("id", "vec").where(F.size("vec") > 0).orderBy("id").toLocalIterator()
    found, part = None, []
    for row in rows:
        part.append(row)
        if len(part) == at_once:
            found, part = _more(found, _slice(part, vectors, k)), []
    if part or found is None:
        found = _more(found, _slice(part, vectors, k))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= k)


def _more(found: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if found is None else found.unionByName(new)


def _slice(queries: list, vectors: DataFrame, k: int) -> DataFrame:
    ids = np.array([r["id"] for r in queries], np.int64)
    asked = np.array([r["vec"] for r in queries], np.float64).reshape(len(queries), -1)
    length = np.linalg.norm(asked, axis=1, keepdims=True)
    asked = np.divide(asked, length, out=np.zeros_like(asked), where=length > 0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(ids), k), WORST, np.int64)  # a million minus a million times the score
        who = np.zeros((len(ids), k), np.int64)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            other = batch.column(0).to_numpy()
            order = np.argsort(other, kind="stable")
            other, own = other[order], np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)[order]
            size = np.linalg.norm(own, axis=1, keepdims=True)
            own = np.divide(own, size, out=np.zeros_like(own), where=size > 0)
            few = min(k, len(other))
            for low in range(0, len(ids), 256):
                part = slice(low, low + 256)
                gap = 1_000_000 - np.rint(asked[part] @ own.T * 1e6).astype(np.int64)
                gap[other == ids[part, None]] = WORST
                key = gap * len(other) + np.arange(len(other))  # of equal scores the smaller id
                key = np.partition(key, few - 1, axis=1)[:, :few]
                pool, names = np.concatenate((top[part], key // len(other)), axis=1), np.concatenate((who[part], other[key % len(other)]), axis=1)
                order = np.argsort(names, axis=1, kind="stable")
                pool, names = np.take_along_axis(pool, order, 1), np.take_along_axis(names, order, 1)
                order = np.argsort(pool, axis=1, kind="stable")[:, :k]
                top[part], who[part] = np.take_along_axis(pool, order, 1), np.take_along_axis(names, order, 1)
        row, place = np.nonzero(top < WORST)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(who[row, place]), pa.array((1_000_000 - top[row, place]) / 1e6)], names=["id", "other", "score"])

    return vectors.select("id", "vec").where(F.size("vec") > 0).mapInArrow(best, "id bigint, other bigint, score double")


def cosine(a: Column, b: Column) -> Column:
    """The same similarity as an expression; 0 with a zero vector."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def hashed_embedding(rows: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """key, bucket and weight: the signed sums of hashed terms, scaled to length 1. No semantic model."""
    word = rows.select(key, F.explode(terms(F.col(text))).alias("term")).withColumn("hash", F.md5("term"))
    bucket = F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") % size
    sign = F.when(F.conv(F.substring("hash", 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    sums = word.select(key, bucket.alias("bucket"), sign.alias("sign")).groupBy(key, "bucket").agg(F.sum("sign").alias("s")).where("s <> 0")
    length = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("l"))
    return sums.join(length, key).select(key, "bucket", F.round(F.col("s") / F.col("l"), 6).alias("weight"))


def best_first(group: str) -> Window:
    """The order of recall: by score, of equal ones by source, chunk and id."""
    return Window.partitionBy(group).orderBy(F.desc("score"), "source", "chunk_index", "result_id")


def recalled(candidates: DataFrame, group: str, top_k: int, multiplier: int = 1) -> DataFrame:
    """The first top_k * multiplier candidates of each group with their vector_rank."""
    return candidates.withColumn("vector_rank", F.row_number().over(best_first(group))).where(F.col("vector_rank") <= top_k * multiplier)


def length_alpha(query: Column, limit: int = 12, short: float = 0.4, long: float = 0.6) -> Column:
    return F.when(F.length(query) <= limit, short).otherwise(long)


def fused(candidates: DataFrame, group: str, query: str, alpha: Column, keep_text: bool = False) -> DataFrame:
    """The candidates (with vector_rank) and bm25, fused and fused_rank; a group without any BM25 signal keeps its scores.

    The texts are left behind before the shuffle unless `keep_text`.
    """
    scored = bm25.candidate_scores(candidates, group, query, "result_id", "text", keep_text)
    joined = scored.withColumn("fused", mixed_score(alpha, group))
    return joined.withColumn("fused_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("fused"), "vector_rank")))


def mixed_score(alpha: Column, group: str) -> Column:
    """alpha of a row's bm25, as a part of its group's highest, and the rest of its score."""
    most = F.max("bm25").over(Window.partitionBy(group))
    return F.round(F.when(most <= 0, F.col("score")).otherwise(alpha * F.col("bm25") / most + (1 - alpha) * F.col("score")), 9)


def jaccard(a: Column, b: Column) -> Column:
    """Shared terms of all terms of two texts: the default re-scorer."""
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def reranked(candidates: DataFrame, group: str, rank: str, top_k: int, scorer: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The first top_k by the scorer's column `rescore`, of equal ones in the order before.

    That order is kept without a scorer, where the scorer raises a RetrievalError, and in each group where it gave a row
    no number (as hooks.ModelScorer does for what its model can't score).
    """
    try:
        scored = scorer(candidates) if scorer else None
    except RetrievalError as e:
        logging.getLogger(__name__).warning("the order before is kept: %s", e)
        scored = None
    if scored is None:
        return candidates.where(F.col(rank) <= top_k).withColumn("final_rank", F.col(rank))
    whole = F.min(F.col("rescore").isNotNull()).over(Window.partitionBy(group))
    order = Window.partitionBy(group).orderBy(F.desc("__rescore"), rank)
    ranked = scored.withColumn("__rescore", F.when(whole, F.col("rescore"))).withColumn("final_rank", F.row_number().over(order))
    return ranked.where(F.col("final_rank") <= top_k).drop("__rescore")


def within_budget(results: DataFrame, group: str, rank: str, budget: int) -> DataFrame:
    """The leading results whose context pieces fit the token budget together; the first one always stays."""
    piece = piece_of_context(F.col("source"), F.col("text"))
    summed = F.sum("tokens").over(Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("piece", piece).withColumn("tokens", token_estimate(F.col("piece"))).withColumn("used", summed).where((F.col(rank) == 1) | (F.col("used") <= budget))


def prompts(kept: DataFrame, group: str, rank: str) -> DataFrame:
    """group and context: the kept pieces in their order, as one text."""
    pieces = F.array_sort(F.collect_list(F.struct(rank, "piece")))
    return kept.groupBy(group).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n\n---\n\n").alias("context"))
