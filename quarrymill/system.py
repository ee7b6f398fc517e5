"""Ingest, search and upkeep of an index, on the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.config import Settings
from quarrymill.errors import IndexStoreError, RetrievalError
from quarrymill.hooks import Embedder, HashingEmbedder, retried
from quarrymill.operators import index, retrieve, splitting
from quarrymill.session import written

NO_HITS = "未找到相关内容。"
CHUNKS = "source string, chunk_index int, text string, content_hash string, vec array<double>"


class RetrievalSystem:
    """An index in a folder. Files come as path and text; questions as qid and query."""

    def __init__(self, spark: SparkSession, settings: Settings, embedder: Embedder | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.settings, self.scorer = spark, settings, scorer
        self.embedder = embedder or HashingEmbedder()
        self.store = index.Snapshots(spark, settings.folder)

    def chunks(self) -> DataFrame:
        try:
            found = self.store.load()
        except IndexStoreError:
            return self.spark.createDataFrame([], CHUNKS)
        sizes = found.select(F.size("vec").alias("n")).distinct().limit(2).collect()
        if any(r["n"] != self.embedder.size for r in sizes):
            raise IndexStoreError(f"the index doesn't hold vectors of {self.embedder.size} numbers")
        return found

    def ingest(self, files: DataFrame, force: bool = False) -> dict[str, int]:
        """Adds new files, replaces changed ones under `force`, leaves the others; files that vanished stay.

        A changed file that is blank or gives no chunks any more loses its old ones; a new blank one is passed over.
        `files` counts those that were added or updated.
        """
        stored = self.chunks()
        ready = index.stripped(files, "path", "text")
        hashes = stored.groupBy("source").agg(F.min("content_hash").alias("content_hash"))
        blank = ready.where(F.length("text") == 0).select("path")
        what = index.classified(ready, hashes, force)
        what = written(what.join(blank, "path", "left_anti").unionByName(what.join(blank, "path", "left_semi").where("action <> 'add'")), "ingest")
        taken = ready.join(what.where("action <> 'skip'").select("path"), "path", "left_semi")
        settings = self.settings.chunking
        pieces = splitting.split_documents(taken, "path", "text", settings.size, settings.overlap, settings.separators, carry=("content_hash",))
        keyed = written(pieces.withColumn("key", F.concat_ws("\u0001", "path", "chunk_index")), "pieces")
        new = keyed.join(self.embedder(keyed, "key", "text"), "key").select(F.col("path").alias("source"), "chunk_index", "text", "content_hash", "vec")
        counts = {r["action"]: r["count"] for r in what.groupBy("action").count().collect()}
        if counts.get("add", 0) + counts.get("update", 0):
            gone = what.where("action = 'update'").select(F.col("path").alias("source"))
            self.store.commit(index.without(stored, gone).select(*new.columns).unionByName(new))
        return {"files": counts.get("add", 0) + counts.get("update", 0), "chunks": keyed.count(), "skipped": counts.get("skip", 0), "updated": counts.get("update", 0)}

    def remove(self, source: str) -> int:
        """How many chunks went; a new snapshot is made only if any did."""
        stored = self.chunks()
        n = stored.where(F.col("source") == source).count()
        if n:
            self.store.commit(stored.where(F.col("source") != source))
        return n

    def info(self) -> DataFrame:
        return index.store_statistics(self.chunks())

    def sources(self) -> DataFrame:
        return self.chunks().select("source").distinct()

    def search(self, questions: DataFrame) -> DataFrame:
        """qid, source, chunk_index, text, score and rank_no of the best chunks for each question."""
        use, stored = self.settings.retrieval, self.chunks()
        if stored.isEmpty():
            raise RetrievalError("the index is empty")
        numbered = stored.withColumn("result_id", F.xxhash64("source", "chunk_index"))
        vectors = self.embedder(questions, "qid", "query", query=True).select(F.col("qid").alias("id"), "vec")
        wide = use.top_k * (use.multiplier if use.hybrid or use.rerank else 1)
        near = retrieve.cosine_top_k(vectors, numbered.select(F.col("result_id").alias("id"), "vec"), wide)
        near = near.select(F.col("id").alias("qid"), F.col("other").alias("chunk"), "score", F.col("rank_no").alias("vector_rank"))
        texts = numbered.select(F.col("result_id").alias("chunk"), "source", "chunk_index", "text")
        found = near.join(texts, "chunk").join(questions.select("qid", "query"), "qid").withColumn("result_id", F.xxhash64("qid", "chunk"))
        rank = "vector_rank"
        if use.hybrid:
            alpha = retrieve.length_alpha(F.col("query"), use.short_query, use.short_alpha, use.long_alpha) if use.adaptive else F.lit(use.alpha)
            found = retrieve.fused(found, "qid", "query", alpha, keep_text=True).withColumn("score", F.col("fused"))
            rank = "fused_rank"
        final = retrieve.reranked(found, "qid", rank, use.top_k, self.scorer if use.rerank else None)
        score = F.col("rescore") if use.rerank and self.scorer else F.col("score")
        return final.select("qid", "source", "chunk_index", "text", score.alias("score"), F.col("final_rank").alias("rank_no"))

    def prompts(self, questions: DataFrame) -> DataFrame:
        """qid, query, context and sources: what a generator needs, within the token budget."""
        kept = retrieve.within_budget(self.search(questions), "qid", "rank_no", self.settings.retrieval.context_tokens)
        sources = kept.groupBy("qid").agg(F.array_sort(F.collect_set("source")).alias("sources"))
        return questions.select("qid", "query").join(retrieve.prompts(kept, "qid", "rank_no"), "qid", "left").join(sources, "qid", "left")

    def answers(self, questions: DataFrame, generate: Callable[[str, str], str], history: str | None = None) -> DataFrame:
        """qid, answer and sources: what `generate` makes of each context and question, with the sources named after it.

        `history` names a column of `questions` with the messages before, put in front of the context. A question
        without any hit gets NO_HITS. The call runs in the tasks; one that fails for a passing reason is made again.
        """

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = retried(generate)
            for frame in frames:
                said = [NO_HITS if c is None else call(c if h is None else f"{h}\n\n{c}", q) for c, q, h in zip(frame["context"], frame["query"], frame["history"])]
                yield pd.DataFrame({"qid": frame["qid"], "said": said, "sources": frame["sources"]})

        before = questions.select(F.col("qid").alias("__qid"), (F.col(history) if history else F.lit(None).cast("string")).alias("history"))
        asked = self.prompts(questions).join(before, F.col("qid") == F.col("__qid")).select("qid", "query", "context", "sources", "history")
        said = asked.mapInPandas(ask, "qid bigint, said string, sources array<string>")
        named = F.concat("said", F.lit("\n\n参考来源: "), F.array_join("sources", ", "))
        return said.select("qid", F.when(F.size("sources") > 0, named).otherwise(F.col("said")).alias("answer"), "sources")
