"""Reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where the session runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table: read as often as needed, computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _tidy.setdefault("paths", []).append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads any more, before the driver ends."""
    path = getattr(df, "written_to", None)
    if path:
        _tidy["paths"] = [(s, p) for s, p in _tidy.get("paths", []) if p != path]
        _delete(df.sparkSession, path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer pieces than there are cores, dealt out to all of them; of large inputs it stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def bounded_broadcast(df: DataFrame, rows: int = 2_000_000, most_bytes: int = 128 << 20) -> DataFrame:
    """df to be broadcast if it has no more than so many rows and bytes, else as it is, for a shuffled join."""
    held = df.agg(F.count("*").alias("n"), F.sum(sum((_bytes(F.col(f"`{name}`"), kind) for name, kind in df.dtypes), F.lit(0))).alias("b")).first()
    return F.broadcast(df) if held["n"] <= rows and (held["b"] or 0) <= most_bytes else df


def _bytes(column: Column, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if kind == "array<string>":
        return F.coalesce(F.aggregate(column, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 8), F.lit(0))
    if kind.startswith("array"):
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 8
    return F.lit(8)


_tidy: dict[str, list[tuple[SparkSession, str]]] = {}


@atexit.register
def drop_written() -> None:
    """Deletes all tables that written() made; between the queries of a long session, when their results have been taken."""
    for spark, path in _tidy.pop("paths", []):
        if not _delete(spark, path):
            return


def _delete(spark: SparkSession, path: str) -> bool:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return bool(hadoop.getFileSystem(conf).delete(hadoop, True)) or True
    except Exception:  # the session has ended: the folder belongs to the cluster
        return False
