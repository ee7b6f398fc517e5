"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.llm import oracles
from quarrymill.session import table


def countable(results: DataFrame) -> DataFrame:
    """Search results that count: a query, a source and a finite score."""
    score = F.col("score")
    return results.where(F.col("query").isNotNull() & F.col("source").isNotNull() & score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_items(spark, sf_dir).withColumnRenamed("item_id", "id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.neardup import alike, all_pairs

    return all_pairs(*alike(p1_texts(spark, sf_dir)))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.neardup import alike, groups

    return groups(*alike(p1_texts(spark, sf_dir)))


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "kb_documents").select(F.lit("file").alias("kind"), F.col("file_id").alias("item_id"), F.col("content").alias("text"))
    chunks = table(spark, sf_dir, "kb_chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), "text")
    return files.unionByName(chunks)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.sentences import sentences

    return sentences(table(spark, sf_dir, "kb_documents"), "file_id", "content")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "chunk_vectors"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.nearest import pairs

    return pairs(p3_neighbours(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.pieces import pieces

    return pieces(p4_items(spark, sf_dir), ["kind", "item_id"], "text")


def p4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.pieces import pieces

    return pieces(p4_items(spark, sf_dir), ["kind", "item_id"], "text", placing="balanced")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.topn import top_n_per_group

    rows = countable(table(spark, sf_dir, "search_results")).select(T.one_spaced(F.col("query")).alias("query"), "source", "chunk_index", "score", "result_id")
    return top_n_per_group(rows, F.col("query"), [("score", True), ("source", False), ("chunk_index", False), ("result_id", False)], "result_id", 5)


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.leakage import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).where("kind = 'copied'").select("doc_id", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.mixing import mix, unreachable

    # The definition counts by source alone, so that no classifier takes part, and the fit is exact but for rounding.
    return unreachable(mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), label_weight=1.0).report, tolerance=1e-6)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report


def p7_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.mixing import copies, mix

    return copies(mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).rates)


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.reading import reading_levels

    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).select("doc_id", "reading_level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_found": p4_found,
    "p4_balanced": p4_balanced,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_draw": p7_draw,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}
SQL: dict[str, str] = oracles.SQL
