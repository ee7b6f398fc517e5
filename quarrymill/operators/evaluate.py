"""How well a ranking finds what is relevant, and how sure that is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranks(questions: DataFrame, results: DataFrame, qid: str, relevant: str, rank: str, source: str, top_k: int) -> DataFrame:
    """qid and the 0-based rank of the first result from the relevant source, -1 beyond top_k or without one."""
    hits = results.where(F.col(rank) <= top_k).select(qid, F.col(source).alias(relevant), F.col(rank).alias("__rank"))
    met = questions.select(qid, relevant).join(hits, [qid, relevant], "left")
    return met.groupBy(qid).agg(F.coalesce(F.min("__rank") - 1, F.lit(-1)).cast("int").alias("rank"))


def rankings(questions: DataFrame, results: DataFrame, keys: list[str], asked: str, relevant: str, rank_of: dict[str, str], source: str, top_k: int) -> DataFrame:
    """`keys` of each question and the rank (as in ranks()) of its source in each of several rankings of the same results."""
    hits = results.select(asked, F.col(source).alias(relevant), *[F.when(F.col(r) <= top_k, F.col(r)).alias(f"__{name}") for name, r in rank_of.items()])
    best = [F.coalesce(F.min(f"__{name}") - 1, F.lit(-1)).cast("int").alias(name) for name in rank_of]
    return questions.join(hits, [asked, relevant], "left").groupBy(*keys).agg(*best)


def reciprocal(rank: Column) -> Column:
    return F.when(rank >= 0, 1.0 / (rank + 1)).otherwise(0.0)


def quality(ranked: DataFrame, kind: str) -> DataFrame:
    """MRR and recall for each kind of question and for all of them (kind null)."""
    return ranked.rollup(kind).agg(
        F.count("*").alias("n"), F.round(F.avg(reciprocal(F.col("rank"))), 6).alias("mrr"), F.round(F.avg((F.col("rank") >= 0).cast("double")), 6).alias("recall")
    )


def distribution(ranked: DataFrame) -> DataFrame:
    """Of the questions whose source was found: how the ranks spread."""
    found = ranked.where("rank >= 0")
    return found.agg(
        F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean"), F.percentile("rank", 0.5).alias("median"), F.min("rank").alias("least"), F.max("rank").alias("most"),
        F.count_if(F.col("rank") < 1).alias("top1"), F.count_if(F.col("rank") < 5).alias("top5"), F.count_if(F.col("rank") < 10).alias("top10"),
    )


def deltas(both: DataFrame) -> DataFrame:
    """How many questions a second ranking (rank_b) serves better, worse or alike, and how many neither finds."""
    change = reciprocal(F.col("rank_b")) - reciprocal(F.col("rank_a"))
    return both.agg(F.count_if(change > 0).alias("better"), F.count_if(change < 0).alias("worse"), F.count_if(change == 0).alias("alike"), F.count_if((F.col("rank_a") < 0) & (F.col("rank_b") < 0)).alias("both_missed"))


def effect(both: DataFrame) -> DataFrame:
    """Difference of the means, Cohen's d with its label, and the relative lift in percent (infinite from nothing)."""
    a, b = reciprocal(F.col("rank_a")), reciprocal(F.col("rank_b"))
    base = both.agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    d = F.when(pooled > 0, (F.col("b") - F.col("a")) / pooled).otherwise(0.0)
    size = F.abs(d)
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    lift = F.when(F.col("a") > 0, (F.col("b") - F.col("a")) / F.col("a") * 100).otherwise(F.lit(float("inf")))
    return base.select(F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.round(d, 6).alias("cohens_d"), label.alias("label"), F.round(lift, 4).alias("lift_percent"))


def normal_interval(ranked: DataFrame) -> DataFrame:
    """Mean reciprocal rank with 1.96 standard errors each way, within 0 and 1."""
    r = reciprocal(F.col("rank"))
    base = ranked.agg(F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.count("*").alias("n"))
    wide = 1.96 * F.col("s") / F.sqrt("n")
    return base.select(F.round("m", 6).alias("mrr"), F.round(F.greatest(F.lit(0.0), F.col("m") - wide), 6).alias("low"), F.round(F.least(F.lit(1.0), F.col("m") + wide), 6).alias("high"))


# The sums of the Poisson probabilities with mean 1, for 0 to 7 draws.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998980)


def spread(ranked: DataFrame) -> DataFrame:
    """Mean, standard deviation, variance, median and maximum of the reciprocal ranks, and how many aren't 0."""
    r = ranked.select(reciprocal(F.col("rank")).alias("rr"))
    numbers = {"mean": F.avg("rr"), "sd": F.stddev_samp("rr"), "variance": F.var_samp("rr"), "median": F.percentile("rr", 0.5), "most": F.max("rr")}
    return r.agg(F.count("*").alias("n"), *[F.round(c, 6).alias(name) for name, c in numbers.items()], F.count_if(F.col("rr") > 0).alias("non_zero"))


def bootstrap(rows: DataFrame, key: str, value: str, resamples: int) -> DataFrame:
    """95 % interval of the mean of `value`, by Poisson bootstrap: each row draws its own number in each resample from a hash.

    No row needs a position or another row's draw, so that partial sums are all that is shuffled. A resample that draws no
    row has no mean.
    """
    means = _drawn(rows.select(F.col(key).alias("k"), F.col(value).alias("v")), resamples).groupBy("resample").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("mean"))
    return means.agg(F.count("*").alias("resamples"), F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))


def _drawn(rows: DataFrame, resamples: int) -> DataFrame:
    """Each row (k and other columns) once for every resample, with the number of its draws there (w)."""
    spark = rows.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(cores)  # a row stands for `resamples` rows of work
    each = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    u = F.substring(F.md5(F.concat_ws("-", "resample", "k")), 1, 8)
    drawn = sum(((u >= f"{math.ceil(p * (1 << 32)):08x}").cast("int") for p in POISSON), F.lit(0))  # hexadecimal numbers of one length sort as text
    return each.withColumn("w", drawn)


def stratified(rows: DataFrame, key: str, kind: str, values: list[str], resamples: int) -> DataFrame:
    """95 % intervals as in bootstrap() of the means of all `values`, from the same draws, for each kind and for all rows (kind null)."""
    drawn = _drawn(rows.select(F.col(key).alias("k"), F.col(kind).alias("kind"), *values), resamples)
    sums = drawn.groupBy("kind", "resample").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])
    whole = sums.groupBy("resample").agg(F.sum("w").alias("w"), *[F.sum(v).alias(v) for v in values]).withColumn("kind", F.lit(None).cast("string"))
    means = sums.unionByName(whole).select("kind", *[F.try_divide(v, "w").alias(v) for v in values])
    bound = lambda v, p, name: F.round(F.percentile(v, p), 6).alias(f"{v}_{name}")
    return means.groupBy("kind").agg(*[bound(v, p, name) for v in values for p, name in ((0.025, "low"), (0.975, "high"))])
