"""Sessions and their anchor prompts, kept as appended Parquet rows in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.errors import QuarrymillError
from quarrymill.functions.text import slug as slug_of
from quarrymill.hooks import Embedder, HashingEmbedder
from quarrymill.operators import memory, retrieve

SESSIONS = "stem string, date string, time string, slug string, text string"
PROMPTS = "stem string, version bigint, pos int, prompt string"
RAW = "stem string, pos int, prompt string"
VECTORS = "id bigint, prompt string, version bigint, vec array<double>"
MOST_PROMPTS, TAIL = 15, 8000


class ConversationMemory:
    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, extract: Callable[[str], str] | None = None) -> None:
        """`extract` gives a text's prompts, a line each; without it, or when it fails, frequent keywords serve."""
        self.spark, self.folder, self.extract = spark, folder.rstrip("/"), extract
        self.embedder = embedder or HashingEmbedder()

    def _rows(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def sessions(self) -> DataFrame:
        """The newest first, by name."""
        return self._rows("sessions", SESSIONS).withColumn("n_chars", F.length("text")).orderBy(F.desc("stem"))

    def session(self, stem: str) -> str | None:
        """The text of one session by its name, or None."""
        row = self._rows("sessions", SESSIONS).where(F.col("stem") == stem).select("text").first()
        return row["text"] if row else None

    def raw_prompts(self, stem: str) -> DataFrame:
        """pos and prompt of the prompts that one session itself gave, before they were merged."""
        return self._rows("raw", RAW).where(F.col("stem") == stem).select("pos", "prompt").orderBy("pos")

    def write_recent(self, folder: str, n: int = 20) -> None:
        """The last n sessions by name, as JSON lines."""
        self._rows("sessions", SESSIONS).orderBy(F.desc("stem")).limit(n).select("stem", "text").coalesce(1).write.mode("overwrite").json(folder)

    def versions(self) -> DataFrame:
        return self._rows("prompts", PROMPTS).groupBy("version", "stem").agg(F.count("*").alias("n_prompts")).orderBy(F.desc("version"))

    def latest_prompts(self) -> DataFrame:
        """prompt and pos of the newest version that isn't blank."""
        rows = self._rows("prompts", PROMPTS).where(F.trim("prompt") != "")
        last = rows.agg(F.max("version")).first()[0]
        return rows.where(F.col("version") == F.lit(last)).select("prompt", "pos")

    def _prompts(self, text: str) -> DataFrame:
        if self.extract:
            try:
                said = self.spark.createDataFrame([(0, self.extract(text[-TAIL:]))], "id int, said string")
                return memory.prompt_lines(said, "id", "said", n=MOST_PROMPTS).select(F.col("line").alias("prompt"), F.col("line_no").alias("pos"))
            except QuarrymillError:
                pass
        lines = self.spark.createDataFrame(list(enumerate(x.strip() for x in text.split("\n") if x.strip())), "line int, text string")
        rows = memory.anchors(lines, "line", "text").collect()[:MOST_PROMPTS]
        return self.spark.createDataFrame([(r["anchor"], i) for i, r in enumerate(rows)], "prompt string, pos int")

    def _indexed(self) -> DataFrame:
        """The vectors of all prompts; only those that aren't in the index yet are embedded, and all again for an embedder of another size."""
        prompts = self._rows("prompts", PROMPTS).groupBy("prompt").agg(F.max("version").alias("version")).withColumn("id", F.xxhash64("prompt"))
        folder = f"prompt-vectors-{self.embedder.size}"
        known = self._rows(folder, VECTORS)
        new = prompts.join(known.select("id"), "id", "left_anti")
        if not new.isEmpty():
            made = new.join(self.embedder(new, "id", "prompt"), "id").select("id", "prompt", "version", "vec")
            made.coalesce(1).write.mode("append").parquet(f"{self.folder}/{folder}")
        return prompts.join(self._rows(folder, VECTORS).select("id", "vec"), "id")

    def end_session(self, text: str, date: str, time: str, slug: str | None = None) -> str:
        """Keeps the session, its prompts and a new version of all: its own ones first, then those of the version before.

        A blank text, and one that gives no prompt, leaves everything as it was and returns an empty name.
        """
        if not text.strip():
            return ""
        raw = [(r["pos"], r["prompt"]) for r in self._prompts(text).collect()]  # MOST_PROMPTS at most
        if not raw:
            return ""
        one = self.spark.createDataFrame([(date, time, text)], "date string, time string, body string")
        named = one.withColumn("slug", F.lit(slug) if slug else slug_of(F.col("body")))
        named = named.withColumn("stem", F.concat_ws("-", "date", "slug", F.regexp_replace("time", ":", "")))
        stem = named.first()["stem"]
        whole = F.concat(F.lit("# Session: "), F.col("date"), F.lit(" "), F.col("time"), F.lit(" — "), F.col("slug"), F.lit("\n\n"), F.col("body"))
        own = self.spark.createDataFrame([(stem, *r) for r in raw], RAW)
        self._add(memory.merged(own.select("prompt", "pos"), self.latest_prompts(), "prompt").orderBy("side", "pos"), stem)
        own.coalesce(1).write.mode("append").parquet(f"{self.folder}/raw")
        named.select("stem", "date", "time", "slug", whole.alias("text")).write.mode("append").parquet(f"{self.folder}/sessions")
        return stem

    def _add(self, prompts: DataFrame, stem: str) -> None:
        last = self._rows("prompts", PROMPTS).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        rows = [(stem, last + 1, i, r["prompt"]) for i, r in enumerate(prompts.select("prompt").collect())]  # one person's prompts
        self.spark.createDataFrame(rows, PROMPTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/prompts")

    def rollback(self, version: int, today: str) -> bool:
        """Makes a copy of an earlier version the newest one; False if there is none."""
        rows = self._rows("prompts", PROMPTS).where(F.col("version") == version)
        if rows.isEmpty():
            return False
        self._add(rows.orderBy("pos"), f"{today}-rollback")
        return True

    def recall(self, query: str, top_k: int = 5, least: float = 0.35) -> DataFrame:
        """prompt and score of the prompts most like the query."""
        prompts = self._indexed()
        asked = self.spark.createDataFrame([(0, query)], "id bigint, query string")
        near = retrieve.cosine_top_k(self.embedder(asked, "id", "query", query=True), prompts.select("id", "vec"), top_k)
        return near.where(F.col("score") >= least).join(prompts.select(F.col("id").alias("other"), "prompt", "version"), "other").select("prompt", "version", "score", "rank_no")

    def recall_deep(self, query: str, top_k: int = 8) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "qid bigint, query string")
        return memory.deep_recall(asked, self._rows("sessions", SESSIONS), "qid", "query", "stem", "text", top_k).orderBy(F.desc("score"), F.desc("stem"))
