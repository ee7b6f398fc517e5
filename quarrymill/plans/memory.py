"""Queries on sessions, prompts and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import memory
from quarrymill.plans.shared import RESULTS, BLANK, results, sql_strip
from quarrymill.session import table


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.sessions(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("stem"))


def make_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("doc_id", "stem", "date", "time", "slug", "n_chars")


def parse_session_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _sessions(spark, sf_dir).select("doc_id", "stem").unionByName(_stems(spark, sf_dir))
    return names.select("doc_id", "stem", T.session_date(F.col("stem")).alias("date"), T.session_slug(F.col("stem")).alias("slug"))


def last_n_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.newest(_sessions(spark, sf_dir), [F.desc("stem"), F.desc("doc_id")], 20).select("doc_id", "stem")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a day as the versions of that day's notes, numbered by name."""
    order = Window.partitionBy("date").orderBy("stem", "doc_id")
    return _sessions(spark, sf_dir).withColumn("version", F.row_number().over(order)).select("date", "version", "stem", "doc_id", "n_chars")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by(F.struct("stem", "doc_id"), "version").alias("v")
    return _versions(spark, sf_dir).groupBy("date").agg(newest, F.max("version").alias("version")).select("date", "version", "v.stem", "v.doc_id")


def rollback_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    return memory.versions_with_rollback(versions, "date", "version", versions.where("version = 1"), "2026-01-01").select("date", "version", "stem", "n_chars")


def anchor_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.anchors(table(spark, sf_dir, "eval_queries"), "qid", "query")


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.prompt_lines(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "eval_queries").select("query", F.col("qid").alias("pos"))
    old = table(spark, sf_dir, "search_results").where("query is not null").groupBy("query").agg(F.min("result_id").alias("pos"))
    return memory.merged(new, old, "query")


def recall_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where("score >= 0.35").select("result_id", "score")


def recall_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "eval_queries").where("qid % 100 = 0")
    found = memory.deep_recall(questions, table(spark, sf_dir, "documents").where("text is not null"), "qid", "query", "doc_id", "text")
    return found.select("qid", "doc_id", "score", F.md5("snippet").alias("digest"))


def chat_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memory.history(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", ["ts", "event_id"], F.concat_ws(":", "event_id", "event_type"))
    return found.select("event_id", F.array_join("history", ",").alias("history"))


def session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.transcript_digests(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", "event_id", "event_type", "props")


def session_transcript_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.transcripts(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", "event_id", "event_type", "props")


def keyword_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) >= 2)
    return table(spark, sf_dir, "eval_queries").select("qid", F.array_join(words, "|").alias("keywords"))


_HEAD = r"^# Session: (\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}) — ([^\n\r]*)"
_SESSIONS = rf"""sess AS (
    SELECT doc_id, text, d AS date, t AS time, s AS slug, d || '-' || s || '-' || replace(t, ':', '') || '00' AS stem, length(text)::INT AS n_chars FROM (
        SELECT doc_id, text, regexp_extract(text, '{_HEAD}', 1) AS d, regexp_extract(text, '{_HEAD}', 2) AS t, {sql_strip(f"regexp_extract(text, '{_HEAD}', 3)")} AS s
        FROM documents WHERE regexp_matches(text, '{_HEAD}'))
)"""
_VERSIONS = f"{_SESSIONS}, versions AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY stem, doc_id)::INT AS version, stem, doc_id, n_chars FROM sess)"
_DATE = r"CASE WHEN regexp_matches(stem, '^\d{4}-\d{2}-\d{2}-.+-\d{6}$') OR (length(stem) >= 10 AND regexp_matches(stem, '^\d{4}-')) THEN left(stem, 10) ELSE '' END"
_NAME = r"CASE WHEN regexp_matches(stem, '^\d{4}-\d{2}-\d{2}-.+-\d{6}$') THEN regexp_extract(stem, '^\d{4}-\d{2}-\d{2}-(.+)-\d{6}$', 1) WHEN length(stem) >= 10 AND regexp_matches(stem, '^\d{4}-') THEN substr(stem, 12) ELSE stem END"
_H = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"

QUERIES = {
    "make_slug": make_slug, "list_sessions": list_sessions, "parse_session_name": parse_session_name, "last_n_sessions": last_n_sessions, "latest_version": latest_version,
    "rollback_version": rollback_version, "anchor_keywords": anchor_keywords, "prompt_lines": prompt_lines, "merge_dedup": merge_dedup, "recall_threshold": recall_threshold,
    "recall_deep": recall_deep, "chat_history_window": chat_history_window, "session_transcript": session_transcript,
    "session_transcript_parts": session_transcript_parts, "keyword_minimum": keyword_minimum,
}

SQL = {
    "make_slug": rf"SELECT doc_id, left(trim(regexp_replace(lower(left(split_part({sql_strip('text')}, chr(10), 1), 80)), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '-'), 30) AS slug FROM documents",
    "list_sessions": f"WITH {_SESSIONS} SELECT doc_id, stem, date, time, slug, n_chars FROM sess",
    "parse_session_name": rf"WITH {_SESSIONS}, names AS (SELECT doc_id, stem FROM sess UNION ALL SELECT doc_id, regexp_extract(path, '([^/]+?)(\.[^./]+)?$', 1) FROM documents) SELECT doc_id, stem, {_DATE} AS date, {_NAME} AS slug FROM names",
    "last_n_sessions": f"WITH {_SESSIONS} SELECT doc_id, stem FROM sess ORDER BY stem DESC, doc_id DESC LIMIT 20",
    "latest_version": f"WITH {_VERSIONS} SELECT date, version, stem, doc_id FROM versions QUALIFY version = max(version) OVER (PARTITION BY date)",
    "rollback_version": f"""WITH {_VERSIONS} SELECT date, version, stem, n_chars FROM versions UNION ALL
        SELECT v.date, m.last + 1, '2026-01-01-rollback-' || lpad((m.last + 1)::VARCHAR, 6, '0'), v.n_chars
        FROM versions v JOIN (SELECT date, max(version) AS last FROM versions GROUP BY date) m USING (date) WHERE v.version = 1""",
    "anchor_keywords": rf"""WITH lines AS (SELECT qid, regexp_replace(query, '^(Q\d*[：:]|A\d*[：:]|\d+\.\s*)', '') AS line FROM eval_queries), each AS (
        SELECT qid, unnest(list_concat(regexp_extract_all(line, '{_H}{{2,6}}'), regexp_extract_all(line, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}A-Za-z]{{4,12}}'))) AS anchor,
            generate_subscripts(list_concat(regexp_extract_all(line, '{_H}{{2,6}}'), regexp_extract_all(line, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}A-Za-z]{{4,12}}')), 1) AS place FROM lines
    ), top AS (SELECT anchor, count(*) AS n_seen, min(qid * 100000 + place) AS first FROM each GROUP BY anchor ORDER BY n_seen DESC, first LIMIT 30)
    SELECT anchor, n_seen FROM top WHERE anchor NOT IN ({', '.join(map(repr, memory.STOP_WORDS))})""",
    "prompt_lines": rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), bare AS (
        SELECT doc_id, i, {sql_strip(f"regexp_replace({sql_strip('x')}, '^[0-9.*{BLANK[1:-1]}-]+', '')")} AS line FROM lines WHERE {sql_strip('x')} <> ''
    ) SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT - 1 AS line_no FROM bare WHERE length(line) BETWEEN 4 AND 40 AND NOT starts_with(line, '#')) WHERE line_no < 15""",
    "merge_dedup": rf"""WITH both_ AS (SELECT query AS prompt, 0 AS side, qid AS pos FROM eval_queries UNION ALL SELECT query, 1, min(result_id) FROM search_results WHERE query IS NOT NULL GROUP BY query)
        SELECT prompt, side, pos FROM both_ QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(prompt), '{BLANK}+', '', 'g') ORDER BY side, pos) = 1""",
    "recall_threshold": f"WITH {RESULTS} SELECT result_id, score FROM results WHERE score >= 0.35",
    "recall_deep": r"""WITH asked AS (SELECT qid, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: length(w) >= 2) AS words FROM eval_queries WHERE qid % 100 = 0), met AS (
        SELECT qid, doc_id, text, words, list_sum(list_transform(words, lambda w: ((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w))::INT))::INT AS score FROM asked, documents WHERE text IS NOT NULL
    ), top AS (SELECT * FROM met WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) <= 8)
    SELECT qid, doc_id, score, md5(substr(text, greatest(1, list_filter(list_transform(words, lambda w: strpos(lower(text), w)), lambda p: p > 0)[1] - 150), 500)) AS digest FROM top""",
    "chat_history_window": "SELECT event_id, coalesce(string_agg(event_id || ':' || event_type, ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM events WHERE user_id IS NOT NULL",
    "session_transcript": "SELECT user_id, md5(t) AS digest, length(t)::INT AS n_chars FROM (SELECT user_id, string_agg(event_type || ': ' || props, chr(10) ORDER BY event_id) AS t FROM events WHERE user_id IS NOT NULL GROUP BY user_id)",
    "session_transcript_parts": f"""WITH whole AS (SELECT user_id, string_agg(event_type || ': ' || props, chr(10) ORDER BY event_id) AS t FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
        SELECT user_id, part_no, substr(t, part_no * {memory.PART} + 1, {memory.PART}) AS text FROM (SELECT *, unnest(range((length(t) + {memory.PART - 1}) // {memory.PART})) AS part_no FROM whole)""",
    "keyword_minimum": r"SELECT qid, array_to_string(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: length(w) >= 2), '|') AS keywords FROM eval_queries",
}
