"""The chunk index: what an ingest has to do, changes by source, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.errors import IndexStoreError, IngestionError
from quarrymill.functions.text import plain_markdown


def stripped(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, text without markup and content_hash of each file, blank ones too."""
    plain = files.select(F.col(path).alias("path"), F.coalesce(plain_markdown(F.col(content)), F.lit("")).alias("text"))
    return plain.withColumn("content_hash", F.sha2("text", 256))


def prepared(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, text and content_hash of each file whose text isn't blank once markup is stripped."""
    return stripped(files, path, content).where(F.length("text") > 0)


def sources(chunks: DataFrame) -> DataFrame:
    """source and content_hash, of an index whose rows may lack hashes: the first one by chunk_id wins."""
    first = F.min_by("content_hash", F.when(F.col("content_hash").isNotNull() & (F.col("content_hash") != ""), F.col("chunk_id")))
    return chunks.groupBy("source").agg(first.alias("content_hash"))


def classified(incoming: DataFrame, stored: DataFrame, force: bool) -> DataFrame:
    """path, content_hash and action: add for a new source, skip for a known one, update for a changed one under force.

    A stored source without a hash counts as changed.
    """
    known = stored.select(F.col("source").alias("path"), F.col("content_hash").alias("stored_hash"), F.lit(True).alias("known"))
    joined = incoming.select("path", "content_hash").join(known, "path", "left")
    changed = ~F.col("content_hash").eqNullSafe(F.col("stored_hash"))
    action = F.when(F.col("known").isNull(), "add").when(F.lit(force) & changed, "update").otherwise("skip")
    return joined.select("path", "content_hash", action.alias("action"))


def latest(chunks: DataFrame) -> DataFrame:
    """Of a (source, chunk_index) indexed more than once, the row indexed last."""
    values = F.struct(*[c for c in chunks.columns if c not in ("source", "chunk_index")])
    newest = chunks.groupBy("source", "chunk_index").agg(F.max_by(values, F.struct("indexed_at", "chunk_id")).alias("v"))
    return newest.select("source", "chunk_index", "v.*")


def without(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """The chunks whose source isn't in `removed` (source)."""
    return chunks.join(removed.select("source").distinct(), "source", "left_anti")


def replaced(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks with those of the sources in `new` exchanged for the new ones, which stand last (column `added`)."""
    if set(new.columns) != set(chunks.columns):
        raise IngestionError(f"chunks have the columns {sorted(chunks.columns)}, the new ones {sorted(new.columns)}")
    return without(chunks, new).withColumn("added", F.lit(0)).unionByName(new.withColumn("added", F.lit(1)))


def store_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("source").alias("n_sources"))


class Snapshots:
    """An index kept as whole Parquet snapshots in a folder; a new one is complete before it is pointed to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def commit(self, chunks: DataFrame) -> str:
        """A pointer is written under another name and then renamed, so that none is ever seen half-written."""
        name = f"snapshot-{uuid.uuid4().hex}"
        chunks.write.parquet(f"{self.folder}/{name}")
        half = self._path(f"half-{name}")
        out = self._fs.create(half, False)
        out.writeBytes(name)
        out.close()
        numbers = [int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path("")) if s.getPath().getName().startswith("commit-")]
        pointer = self._path(f"commit-{max(numbers, default=0) + 1:012d}")
        if self._fs.exists(pointer) or not self._fs.rename(half, pointer):
            raise IndexStoreError(f"another commit came first in {self.folder}")
        return name

    def load(self) -> DataFrame:
        if not self._fs.exists(self._path("")):
            raise IndexStoreError(f"there is no index in {self.folder}")
        commits = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.getPath().getName().startswith("commit-"))
        if not commits:
            raise IndexStoreError(f"no snapshot was committed in {self.folder}")
        name = self.spark.read.text(f"{self.folder}/{commits[-1]}").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}")


def incremental(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks of sources that aren't indexed yet."""
    return new.join(chunks.select("source").distinct(), "source", "left_anti")
