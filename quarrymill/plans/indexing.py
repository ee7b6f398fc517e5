"""Queries on ingest, the chunk index and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import plain_markdown
from quarrymill.operators import index, splitting
from quarrymill.plans.shared import sql_strip
from quarrymill.session import table
from quarrymill.sources.files import SUFFIXES, suffix


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kb_documents").select("file_id", "path", "content")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kb_chunks").select("chunk_id", "source", "chunk_index", "text", "content_hash", "indexed_at")


def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", plain_markdown(F.col("content")).alias("t")).select("file_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = suffix(F.col("path"))
    return _files(spark, sf_dir).select(end.alias("suffix"), end.isin(*SUFFIXES).alias("supported")).groupBy("suffix", "supported").agg(F.count("*").alias("n"))


def metadata_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "kb_documents").select("file_id", F.explode("metadata").alias("name", "value"))
    return entries.select("file_id", "name", F.col("value").cast("string").alias("value"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.prepared(_files(spark, sf_dir), "path", "content").select("path", "content_hash")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as they come: path and the hash the chunk table keeps (of the whole content)."""
    return _files(spark, sf_dir).select("path", F.sha2("content", 256).alias("content_hash"))


def ingest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.classified(_incoming(spark, sf_dir), index.sources(_chunks(spark, sf_dir)), force=True)


def ingest_classify_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without force, against an index that lacks the sources under /kb/ops."""
    stored = index.sources(_chunks(spark, sf_dir).where(~F.col("source").startswith("/kb/ops/")))
    return index.classified(_incoming(spark, sf_dir), stored, force=False)


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = index.sources(_chunks(spark, sf_dir).where(~F.col("source").startswith("/kb/ops/")))
    what = index.classified(_incoming(spark, sf_dir), stored, force=True)
    return what.agg(F.count_if(F.col("action") != "skip").alias("files"), F.count_if(F.col("action") == "add").alias("added"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action") == "update").alias("updated"))


def hash_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sources(_chunks(spark, sf_dir))


def latest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.latest(_chunks(spark, sf_dir)).select("chunk_id", "source", "chunk_index")


def remove_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = _chunks(spark, sf_dir).where(suffix(F.col("source")) == ".html").select("source")
    return index.without(_chunks(spark, sf_dir), removed).select("chunk_id")


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose hash differs from the index get their chunks replaced by new windows of the present content."""
    what = index.classified(_incoming(spark, sf_dir), index.sources(_chunks(spark, sf_dir)), force=True).where("action = 'update'")
    changed = _files(spark, sf_dir).join(what.select("path"), "path", "left_semi").select(F.col("path").alias("source"), "content")
    new = splitting.character_windows(changed, "source", "content", 512, 64)
    kept = _chunks(spark, sf_dir).select("source", "chunk_index", "text")
    return index.replaced(kept, new).select("source", "chunk_index", F.length("text").alias("n_chars"), "added")


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = _chunks(spark, sf_dir).where(~F.col("source").startswith("/kb/ops/"))
    new = _files(spark, sf_dir).select(F.col("path").alias("source"), "file_id")
    return index.incremental(indexed, new).select("source", "file_id")


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.store_statistics(_chunks(spark, sf_dir))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("source").distinct()


def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splitting.character_windows(_files(spark, sf_dir), "file_id", "content", 512, 64)
    return found.select("file_id", "chunk_index", F.md5("text").alias("digest"))


def force_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splitting.character_windows(_files(spark, sf_dir), "file_id", "content", 512, 64, reach_end_once=False)
    return found.select("file_id", "chunk_index", F.md5("text").alias("digest"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "kb_documents").select("file_id", "content", "path", F.col("metadata")["filename"].alias("filename"))
    return splitting.split_documents(files, "file_id", "content", carry=("path", "filename"))


_STORED = """stored AS (
    SELECT source, min_by(content_hash, chunk_id) FILTER (WHERE content_hash IS NOT NULL AND content_hash <> '') AS stored_hash, true AS known
    FROM kb_chunks WHERE {0} GROUP BY source
), what AS (
    SELECT path, sha256(content) AS content_hash, CASE WHEN known IS NULL THEN 'add' WHEN {1} AND sha256(content) IS DISTINCT FROM stored_hash THEN 'update' ELSE 'skip' END AS action
    FROM kb_documents LEFT JOIN stored ON source = path
)"""
# Images, links and empty lines as the specification has them; a dot doesn't match a line break.
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(content, '!\[.*?\]\(.*?\)', '', 'g'), '\[([^\]]*?)\]\(.*?\)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_SUFFIX = r"lower(regexp_extract(path, '\.[^./]+$'))"
_WINDOW = "SELECT {0}, i::INT AS chunk_index, {2} FROM (SELECT *, unnest(range(0, {1})) AS i FROM {3})"
_COUNT = "(CASE WHEN length(content) <= 512 THEN 1 ELSE 1 + ceil((length(content) - 512) / 448.0) END)::BIGINT"

_GAPS = "[" + ", ".join("'" + gap.replace("\n", "\\n").replace("\\n", "' || chr(10) || '") + "'" for gap in splitting.LADDER[:-1]) + "]"
# The splitter with chunks of 512 and an overlap of 128: texts are parted down the ladder of separators, runs of pieces
# that fit are packed one chunk after the other, and a text without any separator is cut into windows.
_SPLIT = f"""WITH RECURSIVE part AS (
    SELECT file_id, content AS body, []::BIGINT[] AS place, 1 AS lvl FROM kb_documents WHERE length(content) > 0
    UNION ALL
    SELECT file_id, pieces[p], list_append(place, p), gap_no + 1 FROM (
        SELECT *, unnest(range(1, len(pieces) + 1)) AS p FROM (
            SELECT *, string_split(body, gaps[gap_no]) AS pieces FROM (
                SELECT *, {_GAPS} AS gaps, list_min(list_filter(range(lvl, 14), lambda i: contains(body, {_GAPS}[i]))) AS gap_no FROM part) a
            WHERE gap_no IS NOT NULL) b
    ) c WHERE length(pieces[p]) > 512
), opened AS (
    SELECT *, {_GAPS}[list_min(list_filter(range(lvl, 14), lambda i: contains(body, {_GAPS}[i])))] AS gap FROM part
), piece AS (
    SELECT file_id, place, gap, p, pieces[p] AS t, count(*) FILTER (WHERE length(pieces[p]) > 512) OVER (PARTITION BY file_id, place ORDER BY p) AS big
    FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS p FROM (SELECT *, string_split(body, gap) AS pieces FROM opened WHERE gap IS NOT NULL))
), run AS (
    SELECT file_id, list_append(place, min(p)) AS place, gap, list(t ORDER BY p) AS ts FROM piece WHERE length(t) <= 512 GROUP BY file_id, place, gap, big
), summed AS (
    SELECT *, length(gap) AS g, list_transform(range(0, len(ts) + 1), lambda i: coalesce(list_sum(list_transform(ts[1:i], lambda x: length(x) + length(gap))), 0)::BIGINT) AS ends FROM run
), chunk AS (
    SELECT *, 0 AS k, 0::BIGINT AS first, list_max(list_filter(range(1, len(ts) + 1), lambda i: ends[i + 1] - g <= 512)) AS last FROM summed
    UNION ALL
    SELECT file_id, place, gap, ts, g, ends, k + 1, first, greatest(last + 1, coalesce(list_max(list_filter(range(last + 1, len(ts) + 1), lambda i: ends[i + 1] - ends[first + 1] - g <= 512)), 0))
    FROM (
        SELECT * REPLACE (least(last, coalesce(list_min(list_filter(range(first, last), lambda b: ends[last + 1] - ends[b + 1] - g <= 128)), last)) AS first) FROM chunk WHERE last < len(ts)
    ) d
), found AS (
    SELECT file_id, place, k, list_reduce(ts[first + 1:last], lambda a, b: a || gap || b) AS text FROM chunk
    UNION ALL
    SELECT file_id, place, i, substr(body, i * 384 + 1, 512) FROM (
        SELECT *, unnest(range(0, CASE WHEN length(body) <= 512 THEN 1 ELSE 1 + ceil((length(body) - 512) / 384.0)::BIGINT END)) AS i FROM opened WHERE gap IS NULL)
)
SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY place, k) - 1)::INT AS chunk_index, text, path, metadata['filename'] AS filename
FROM found JOIN (SELECT file_id, path, metadata FROM kb_documents) USING (file_id) WHERE {sql_strip("text")} <> ''"""

QUERIES = {
    "strip_markup": strip_markup, "supported_files": supported_files, "metadata_strings": metadata_strings, "content_hash": content_hash, "ingest_classify": ingest_classify,
    "ingest_classify_known": ingest_classify_known, "ingest_summary": ingest_summary, "hash_backfill": hash_backfill, "latest_chunks": latest_chunks, "remove_source": remove_source,
    "replace_source": replace_source, "incremental_index": incremental_index, "store_stats": store_stats, "source_list": source_list, "char_windows": char_windows,
    "force_windows": force_windows, "split_documents": split_documents,
}

SQL = {
    "split_documents": _SPLIT,
    "strip_markup": f"SELECT file_id, length(t)::INT AS n_chars, md5(t) AS digest FROM (SELECT file_id, {sql_strip(_PLAIN)} AS t FROM kb_documents)",
    "supported_files": f"SELECT {_SUFFIX} AS suffix, {_SUFFIX} IN ({', '.join(repr(s) for s in SUFFIXES)}) AS supported, count(*) AS n FROM kb_documents GROUP BY ALL",
    "metadata_strings": "SELECT file_id, e.key AS name, e.value AS value FROM (SELECT file_id, unnest(map_entries(metadata)) AS e FROM kb_documents)",
    "content_hash": f"SELECT path, sha256(t) AS content_hash FROM (SELECT path, {sql_strip(_PLAIN)} AS t FROM kb_documents) WHERE t <> ''",
    "ingest_classify": f"WITH {_STORED.format('true', 'true')} SELECT path, content_hash, action FROM what",
    "ingest_classify_known": f"WITH {_STORED.format('''source NOT LIKE '/kb/ops/%' ''', 'false')} SELECT path, content_hash, action FROM what",
    "ingest_summary": f"""WITH {_STORED.format('''source NOT LIKE '/kb/ops/%' ''', 'true')} SELECT count(*) FILTER (WHERE action IN ('add', 'update')) AS files, count(*) FILTER (WHERE action = 'add') AS added,
        count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE action = 'update') AS updated FROM what""",
    "hash_backfill": "SELECT source, min_by(content_hash, chunk_id) FILTER (WHERE content_hash IS NOT NULL AND content_hash <> '') AS content_hash FROM kb_chunks GROUP BY source",
    "latest_chunks": "SELECT chunk_id, source, chunk_index FROM kb_chunks QUALIFY row_number() OVER (PARTITION BY source, chunk_index ORDER BY indexed_at DESC, chunk_id DESC) = 1",
    "remove_source": "SELECT chunk_id FROM kb_chunks WHERE source NOT IN (SELECT source FROM kb_chunks WHERE lower(source) LIKE '%.html')",
    "replace_source": f"""WITH {_STORED.format('true', 'true')}, changed AS (SELECT path AS source, content FROM kb_documents WHERE path IN (SELECT path FROM what WHERE action = 'update'))
        SELECT source, chunk_index, length(text)::INT AS n_chars, 0 AS added FROM kb_chunks WHERE source NOT IN (SELECT source FROM changed)
        UNION ALL {_WINDOW.format('source', _COUNT, 'length(substr(content, i * 448 + 1, 512))::INT AS n_chars, 1 AS added', 'changed')}""",
    "incremental_index": "SELECT path AS source, file_id FROM kb_documents WHERE path NOT IN (SELECT source FROM kb_chunks WHERE source NOT LIKE '/kb/ops/%')",
    "store_stats": "SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_sources FROM kb_chunks",
    "source_list": "SELECT DISTINCT source FROM kb_chunks",
    "char_windows": _WINDOW.format("file_id", _COUNT, "md5(substr(content, i * 448 + 1, 512)) AS digest", "kb_documents"),
    "force_windows": _WINDOW.format("file_id", "ceil(length(content) / 448.0)::BIGINT", "md5(substr(content, i * 448 + 1, 512)) AS digest", "kb_documents"),
}
