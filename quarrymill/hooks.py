"""Where models come in: embedders and re-scorers as DataFrame functions, with offline defaults."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarrymill.errors import ConfigError, EmbeddingError
from quarrymill.operators.retrieve import hashed_embedding, jaccard

# What stands before queries (not passages) of models that were trained with it.
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："
LONGEST = 16_000
# Answers of a service after which a call is worth making again.
RETRIABLE = (429, 500, 502, 503, 504)


class Embedder(Protocol):
    size: int

    def __call__(self, rows: DataFrame, key: str, text: str, query: bool = False) -> DataFrame:
        """key and vec (array<double>) of every row; `query` says that the texts are questions, not passages."""


class HashingEmbedder:
    """Signed sums of hashed terms: the same in every run, without a model, and without semantics."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def __call__(self, rows: DataFrame, key: str, text: str, query: bool = False) -> DataFrame:
        held = hashed_embedding(rows, key, text, self.size).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "weight"))).alias("m"))
        full = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
        return rows.select(key).join(held, key, "left").select(key, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), self.size)).otherwise(full).alias("vec"))


class ModelEmbedder:
    """A model that `load` makes, once for each task, from texts to rows of numbers.

    Texts are cut to LONGEST characters and go in batches; `prefix` stands before queries alone. Calls that fail for a
    passing reason are made again, `attempts` times in all.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], size: int, batch: int = 32, prefix: str = "", attempts: int = 3, pause: float = 1.0) -> None:
        self.load, self.size, self.batch, self.prefix, self.attempts, self.pause = load, size, batch, prefix, attempts, pause

    def __call__(self, rows: DataFrame, key: str, text: str, query: bool = False) -> DataFrame:
        load, size, batch, prefix, attempts, pause = self.load, self.size, self.batch, self.prefix if query else "", self.attempts, self.pause

        def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = retried(load(), attempts, pause)
            for frame in frames:
                texts, out = [(prefix + t)[:LONGEST] for t in frame["__text"]], []
                for at in range(0, len(texts), batch):
                    part = np.asarray(model(texts[at : at + batch]), float)
                    if part.shape != (len(texts[at : at + batch]), size):
                        raise EmbeddingError(f"the model gave {part.shape}, not {size} numbers for each text")
                    out += list(part)
                yield pd.DataFrame({key: frame[key], "vec": out})

        return rows.select(key, F.col(text).alias("__text")).mapInPandas(embed, f"`{key}` {dict(rows.dtypes)[key]}, vec array<double>")


def embedder_for(kind: str, size: int, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, prefix: str = QUERY_PREFIX) -> Embedder:
    """An embedder by its kind: "hashing" without a model, "local" (batches of 32, with a prefix before queries) or "api" (batches of 100)."""
    if kind == "hashing":
        return HashingEmbedder(size)
    if kind not in ("local", "api"):
        raise ConfigError(f"there is no embedder {kind!r}")
    if load is None:
        raise ConfigError(f"the embedder {kind!r} needs a model")
    return ModelEmbedder(load, size, 32, prefix) if kind == "local" else ModelEmbedder(load, size, 100)


def by_index(answer: list[dict], size: int) -> np.ndarray:
    """The vectors of an answer whose parts name their place in the request, in that order."""
    vectors = [part["embedding"] for part in sorted(answer, key=lambda part: part["index"])]
    return np.asarray(vectors, float).reshape(len(vectors), size)


class ModelScorer:
    """A re-scorer whose model `load` makes, once for each task, from queries and texts to numbers.

    Where the model can't be made, or fails on a batch, `rescore` stays null, and retrieve.reranked() keeps the order
    before in the groups concerned.
    """

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], list[float]]], query: str = "query", text: str = "text", batch: int = 32) -> None:
        self.load, self.query, self.text, self.batch = load, query, text, batch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        load, query, text, batch = self.load, self.query, self.text, self.batch

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                scores: list[float | None] = []
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    try:
                        model = model or load()
                        scores += [float(x) for x in model(list(part[query]), list(part[text]))]
                    except Exception as e:
                        logging.getLogger(__name__).warning("the re-scorer failed: %s", e)
                        scores += [None] * len(part)
                yield frame.assign(rescore=pd.Series(scores, frame.index, float))

        schema = StructType([*pairs.schema.fields, StructField("rescore", DoubleType())])
        scored = pairs.mapInPandas(score, schema)
        return scored.withColumn("rescore", F.when(~F.isnan("rescore"), F.col("rescore")))


def jaccard_scorer(pairs: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    return pairs.withColumn("rescore", jaccard(F.col(query), F.col(text)))


def retried(call: Callable, attempts: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, again after errors that may pass, with doubled pauses up to `most` seconds."""

    def run(*args, **kwargs):
        for attempt in range(1, attempts + 1):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                status = getattr(e, "status_code", None)
                passing = status in RETRIABLE if status is not None else any(w in str(e).lower() for w in ("timeout", "connection", "reset", "network", "retry"))
                if attempt == attempts or not passing:
                    raise
                sleep(min(base * 2 ** (attempt - 1), most))

    return run
