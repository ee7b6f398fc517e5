"""Okapi BM25 over a whole collection, or over the candidates of each query alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import terms
from quarrymill.session import bounded_broadcast, written

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.ln(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def weight(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    average = F.when(average > 0, average).otherwise(1.0)
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def collection(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, terms and length (their number)."""
    return docs.select(key, terms(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: the number of documents and their average length."""
    return collection(docs, key, text).agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))


def document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    return collection(docs, key, text).select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def scores(queries: DataFrame, qid: str, query: str, docs: DataFrame, key: str, text: str) -> DataFrame:
    """qid, key and score of every document that shares a term with the query; repeated query terms count once.

    The collection is read once: of each document its length stays, as the count of an empty term, and the counts of
    the terms that are asked for. A null text counts as a document without length.
    """
    asked = queries.select(qid, F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    spark = docs.sparkSession
    wanted = bounded_broadcast(asked.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string")))
    every = collection(docs, key, text).select(key, "length", F.explode(F.concat(F.coalesce("terms", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    counted = written(every.join(wanted, "term", "left_semi").groupBy("term", key, "length").agg(F.count("*").alias("tf")), "postings")
    total = counted.where("term = ''").agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average")).first()
    n, average = F.lit(total["n"]), F.lit(total["average"])
    tf = counted.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hits = tf.join(df, "term").join(bounded_broadcast(asked), "term")
    return hits.groupBy(qid, key).agg(F.sum(weight(n, F.col("df"), F.col("tf"), F.col("length"), average)).alias("score"))


def candidate_scores(candidates: DataFrame, group: str, query: str, key: str, text: str, keep_text: bool = False) -> DataFrame:
    """The candidates with bm25, 0 without a shared term; n, df and the average are those of the group's candidates.

    Each row counts its query's terms in its own text, so that only numbers are shuffled (and the text under
    `keep_text`), once: all that follows is partitioned by the group.
    """
    words, own = F.array_distinct(terms(F.col(query))), [c for c in candidates.columns if keep_text or c != text]
    counted = candidates.select(*own, words.alias("__words"), terms(F.col(text)).alias("__terms")).select(
        *own, F.size("__terms").alias("__length"), F.filter(F.transform("__words", lambda t: F.struct(t.alias("term"), (F.size("__terms") - F.size(F.array_remove("__terms", t))).alias("tf"))), lambda m: m["tf"] > 0).alias("__met")
    )
    of_group, of_term, of_row = (Window.partitionBy(group, *more) for more in ((), ("__term",), (key,)))
    each = counted.repartition(group).select(*own, "__length", F.posexplode_outer("__met").alias("__at", "__m"))
    each = each.withColumns({"__term": F.col("__m.term"), "__first": F.coalesce(F.col("__at"), F.lit(0)) == 0})
    n = F.count_if("__first").over(of_group)
    average = F.sum(F.when(F.col("__first"), F.col("__length"))).over(of_group) / n
    part = each.withColumns({"__n": n, "__average": average, "__df": F.count("__term").over(of_term)})
    one = F.when(F.col("__term").isNotNull(), weight(F.col("__n"), F.col("__df"), F.col("__m.tf"), F.col("__length"), F.col("__average"))).otherwise(0.0)
    return part.withColumn("bm25", F.sum(one).over(of_row)).where("__first").select(*own, "bm25")
