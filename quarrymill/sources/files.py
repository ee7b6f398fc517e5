"""Files in folders as documents, and chunks, sessions and reports back to files."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.errors import IngestionError
from quarrymill.functions.text import plain_markdown, strip

# The file types that can be taken in, and which of them are plain text.
SUFFIXES = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".html", ".htm", ".md", ".markdown", ".txt", ".csv", ".json", ".xml", ".epub", ".rtf")
TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".csv", ".json", ".xml")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, else null, for a hook that knows the older encodings."""
    return F.try_validate_utf8(content.cast("string"))


def _older(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"path": frame["path"], "text": [bytes(b).decode("gbk", "replace") for b in frame["content"]]})


def texts_of(files: DataFrame) -> DataFrame:
    """path and text of files (path, content): UTF-8 as an expression, and only what isn't UTF-8 as GBK in Python."""
    known = files.where("content is not null").select("path", "content", decoded(F.col("content")).alias("text"))
    older = known.where("text is null").select("path", "content").mapInPandas(_older, "path string, text string")
    return known.where("text is not null").select("path", "text").unionByName(older)


def each_file(convert: Callable[[str, bytes], str], seconds: float = 30.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A `rich` hook for read_folder() from a function of one file; a file on which it fails, or takes longer, is logged and passed over."""

    def rich(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                pool = ThreadPoolExecutor(1)
                try:
                    rows.append((path, pool.submit(convert, path, bytes(content)).result(seconds)))
                except Exception as e:
                    logging.getLogger(__name__).warning("%s is passed over: %r", path, e)
                finally:
                    pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame(rows, columns=["path", "text"], dtype="object")

    return rich


def html_text(html: Column) -> Column:
    """What a reader sees: without scripts, styles, comments and tags; block ends become line breaks; the usual entities are read."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n\s*", "\n"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", rich: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """path, text and metadata (filename) of every readable file below a folder.

    Text files that aren't UTF-8 are read as GBK. Other types go through `rich` (path, content to path, text), a
    mapInPandas function such as each_file() makes; without it HTML is read by html_text() and the rest is left out.
    Blank files, files of other types and files that can't be read give no rows. Rows have no order of their own; sort
    them by path where one is wanted.
    """
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    known = files.withColumn("suffix", suffix(F.col("path"))).where(F.col("suffix").isin(*SUFFIXES)).select("path", "suffix", "content")
    plain = texts_of(known.where(F.col("suffix").isin(*TEXT_SUFFIXES)))
    if rich is None:
        other = known.where(F.col("suffix").isin(".html", ".htm")).select("path", html_text(F.col("content").cast("string")).alias("text"))
    else:
        other = known.where(~F.col("suffix").isin(*TEXT_SUFFIXES)).select("path", "content").mapInPandas(rich, "path string, text string")
    texts = plain.unionByName(other).select("path", plain_markdown(F.col("text")).alias("text")).where(F.length("text") > 0)
    return texts.withColumn("metadata", F.create_map(F.lit("filename"), F.element_at(F.split("path", "/"), -1)))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop) or not files.getFileStatus(hadoop).isFile():
        raise IngestionError(f"{path} is no file")
    return read_folder(spark, path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """A row for each question of evaluation results kept as JSON with a list `per_query`, with the file's name."""
    whole = spark.read.option("multiLine", "true").json(path)
    return whole.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.explode("per_query").alias("q")).select("file", "q.*")


def topic_number(path: Column) -> Column:
    """The first number in a file's name, without its type; null without one."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    return F.try_to_number(F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit("")), F.lit("999999999999999999")).cast("bigint")


def write_json(report: DataFrame, folder: str) -> None:
    report.write.mode("errorifexists").json(folder)


def write_markdown(summary: DataFrame, title: str) -> str:
    """A table of a small summary; no more than 1,000 rows."""
    rows = summary.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a report of more than 1,000 rows")
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "| " + " | ".join("---" for _ in summary.columns) + " |"]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]]) + "\n"
