"""Conversation memory: sessions, anchors, merged prompt versions and recall by words."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import HAN, squeezed, strip
from quarrymill.session import written

# Words too common for an anchor.
STOP_WORDS = ("什么", "怎么", "为什么", "如何", "可以", "应该", "需要", "这个", "那个", "或者")
PART = 8192


def sessions(documents: DataFrame, text: str) -> DataFrame:
    """The documents that open with a session heading, with date, time, slug, stem and n_chars."""
    head = r"^# Session: (\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}) — ([^\n\r]*)"
    found = documents.where(F.col(text).rlike(head))
    part = lambda k: F.regexp_extract(text, head, k)
    named = found.withColumns({"date": part(1), "time": part(2), "slug": strip(part(3))})
    stem = F.concat_ws("-", "date", "slug", F.concat(F.regexp_replace("time", ":", ""), F.lit("00")))
    return named.withColumns({"stem": stem, "n_chars": F.length(text)})


def newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def anchors(prompts: DataFrame, key: str, text: str, n: int = 30) -> DataFrame:
    """anchor, n_seen: the n most frequent Han runs of 2 to 6 and letter runs of 4 to 12; of equal ones, the first seen.

    A run of 4 to 6 Han characters counts as both. Lines count in the order of `key`.
    """
    # Fixed value: the labels of questions and answers, and list numbers, before a line.
    line = F.regexp_replace(text, r"^(Q\d*[：:]|A\d*[：:]|\d+\.\s*)", "")
    han = F.regexp_extract_all(line, F.lit(f"{HAN}{{2,6}}"), F.lit(0))
    mixed = F.regexp_extract_all(line, F.lit(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}A-Za-z]{4,12}"), F.lit(0))
    each = prompts.select(F.col(key).alias("line"), F.posexplode(F.concat(han, mixed)).alias("place", "anchor"))
    counted = each.groupBy("anchor").agg(F.count("*").alias("n_seen"), F.min(F.struct("line", "place")).alias("first"))
    top = counted.orderBy(F.desc("n_seen"), "first").limit(n)
    return top.where(~F.col("anchor").isin(*STOP_WORDS)).select("anchor", "n_seen")


def merged(new: DataFrame, old: DataFrame, text: str) -> DataFrame:
    """text and pos of the distinct prompts of both (text, pos): new ones first; case and white space make no difference, the first spelling stays."""
    both = new.select(F.col(text).alias("prompt"), F.lit(0).alias("side"), "pos").unionByName(old.select(F.col(text).alias("prompt"), F.lit(1).alias("side"), "pos"))
    first = both.groupBy(squeezed(F.col("prompt")).alias("same")).agg(F.min(F.struct("side", "pos", "prompt")).alias("f"))
    return first.select("f.prompt", "f.side", "f.pos")


def prompt_lines(documents: DataFrame, key: str, text: str, shortest: int = 4, longest: int = 40, n: int = 15) -> DataFrame:
    """key, line_no, line: the first n lines of fitting length, without list numbering and headings."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    # Fixed value: the numbering before a line.
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[\d.\-*\s]+", "")))
    fit = F.slice(F.filter(bare, lambda x: (F.length(x) >= shortest) & (F.length(x) <= longest) & ~x.startswith("#")), 1, n)
    return documents.select(key, F.posexplode(fit).alias("line_no", "line"))


def versions_with_rollback(versions: DataFrame, key: str, order: str, back_to: DataFrame, today: str) -> DataFrame:
    """The versions and one more for each of `back_to`: its copy, named by today's date, numbered after the last of its key."""
    last = versions.groupBy(key).agg(F.max(order).alias("__last"))
    again = back_to.join(last, key).withColumn(order, F.col("__last") + 1).withColumn("stem", F.concat(F.lit(f"{today}-rollback-"), F.lpad(F.col(order).cast("string"), 6, "0")))
    return versions.unionByName(again.select(*versions.columns))


def deep_recall(questions: DataFrame, documents: DataFrame, qid: str, query: str, key: str, text: str, top_k: int = 8, at_once: int = 1000) -> DataFrame:
    """qid, key, score, snippet: the documents with most occurrences of the question's words, of equal ones the greater key.

    Words of one character don't count. The snippet begins 150 characters before the first of the words, in the
    question's order, that occurs. Every batch of texts is searched once for each different word, and keeps the top_k of
    each question, so that only these are shuffled. Tasks hold `at_once` questions; more take more passes.
    """
    found, part = None, []
    for row in questions.select(qid, F.lower(query).alias("q")).where("q is not null").toLocalIterator():
        words = [w for w in row["q"].split() if len(w) >= 2]
        part += [(row[qid], words)] if words else []
        if len(part) == at_once:
            found, part = _more(found, _searched(part, documents, qid, key, text, top_k)), []
    if part or found is None:
        found = _more(found, _searched(part, documents, qid, key, text, top_k))
    best = Window.partitionBy(qid).orderBy(F.desc("score"), F.desc(key))
    return found.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= top_k).drop("__n")


def _more(found: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if found is None else found.unionByName(new)


def _searched(asked: list, documents: DataFrame, qid: str, key: str, text: str, top_k: int) -> DataFrame:
    distinct = sorted({w for _, words in asked for w in words})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lower = [t.lower() for t in texts]
            seen = {w: [t.count(w) for t in lower] for w in distinct}
            rows = []
            for question, words in asked:
                scores = [sum(c) for c in zip(*[seen[w] for w in words])]
                met = heapq.nlargest(top_k, ((n, keys[i], i) for i, n in enumerate(scores) if n))
                for n, own, i in met:
                    first = next(at for w in words if (at := lower[i].find(w)) >= 0)
                    start = max(0, first - 150)
                    rows.append((question, own, n, texts[i][start : start + 500]))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], batch.schema.field(0).type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=[qid, key, "score", "snippet"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInArrow(search, f"`{qid}` bigint, `{key}` {kind}, score int, snippet string")


def history(messages: DataFrame, conversation: str, order: list[str], content: Column, n: int = 6) -> DataFrame:
    """Each message with the n before it in its conversation, oldest first."""
    before = Window.partitionBy(conversation).orderBy(*order).rowsBetween(-n, -1)
    return messages.withColumn("history", F.collect_list(content).over(before))


def _lines(messages: DataFrame, conversation: str, order: str, role: str, content: str) -> DataFrame:
    return messages.select(F.col(conversation).alias("__group"), F.col(order).alias("__order"), F.concat(F.col(role), F.lit(": "), F.col(content)).alias("__line"))


def transcripts(messages: DataFrame, conversation: str, order: str, role: str, content: str, size: int = PART, partitions: int | None = None) -> DataFrame:
    """conversation, part_no, text: the role: content lines of each conversation as one text, in parts of `size` characters (the last has the rest).

    The parts in order, with nothing between them, are the transcript. Messages without role or content give no line;
    those of equal order stand by their lines. Messages are range-partitioned and sorted, so that a conversation of any
    size spreads over tasks; the lengths before each partition's start turn local places into places in the transcript.
    """
    partitions = partitions or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _lines(messages, conversation, order, role, content).where("__line IS NOT NULL")
    placed = lines.repartitionByRange(partitions, "__group", "__order").sortWithinPartitions("__group", "__order", "__line").select("__group", "__line", F.spark_partition_id().alias("__in"))
    kept = written(placed.mapInArrow(_placed, placed.select("*", F.lit(0).cast("bigint").alias("__at")).schema), "transcripts")
    sizes = kept.groupBy("__group", "__in").agg(F.sum(F.length("__line") + F.lit(1).cast("bigint")).alias("__size"))
    before = Window.partitionBy("__group").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation per partition began in an earlier one: no more rows than partitions, whatever the data.
    carried = sizes.withColumn("__before", F.sum("__size").over(before)).where("__before > 0").select(F.col("__group").alias("__g"), F.col("__in").alias("__i"), "__before")
    joined = kept.join(F.broadcast(carried), kept["__group"].eqNullSafe(F.col("__g")) & (kept["__in"] == F.col("__i")), "left")
    at = F.col("__at") + F.coalesce("__before", F.lit(0))
    # All lines but the first begin with the line feed before them.
    items = joined.select("__group", F.when(at > 0, at - 1).otherwise(0).alias("__at"), F.when(at > 0, F.concat(F.lit("\n"), "__line")).otherwise(F.col("__line")).alias("__item"))
    last = F.col("__at") + F.length("__item") - 1
    each = items.withColumn("part_no", F.explode(F.sequence(F.floor(F.col("__at") / size), F.floor(last / size))))
    start = F.greatest(F.lit(0).cast("bigint"), F.col("part_no") * size - F.col("__at"))
    piece = F.substring(F.col("__item"), (start + 1).cast("int"), F.lit(size) - F.greatest(F.lit(0).cast("bigint"), F.col("__at") - F.col("part_no") * size).cast("int"))
    parts = each.groupBy("__group", "part_no").agg(F.array_sort(F.collect_list(F.struct("__at", piece.alias("piece")))).alias("pieces"))
    return parts.select(F.col("__group").alias(conversation), "part_no", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("text"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters before each line in its conversation, as far as they are in this partition."""
    last, run = None, 0  # the conversation that the batch before ended in, and its characters so far
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(0)
        code = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
        ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64) + 1)
        begins = np.concatenate(([0], ends[:-1]))
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        base = begins[starts]
        base[0] -= run if last is not None and last[0] == groups[0].as_py() else 0
        base = np.repeat(base, np.diff(np.append(starts, len(code))))
        last, run = (groups[-1].as_py(),), int(ends[-1] - base[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begins - base)], names=["__group", "__line", "__in", "__at"])


def transcript_digests(messages: DataFrame, conversation: str, order: str, role: str, content: str) -> DataFrame:
    """conversation, MD5 and length of its whole transcript; null for one without lines.

    A digest needs a conversation's lines one after the other, so one task has them all, but it holds no more than a
    batch of them: they are sorted on disk and digested as they come.
    """
    lines = _lines(messages, conversation, order, role, content)
    kind = lines.schema["__group"].dataType.simpleString()
    ordered = lines.repartition("__group").sortWithinPartitions("__group", "__order", "__line").select("__group", "__line")
    return ordered.mapInArrow(_digested, f"__group {kind}, digest string, n_chars bigint").withColumnRenamed("__group", conversation)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, digest, size = None, None, 0

    def rows(done: list) -> pa.RecordBatch:
        names, digests, sizes = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["__group", "digest", "n_chars"])

    def closed() -> tuple:
        return last[0], digest and digest.hexdigest(), size if digest else None

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for group, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last is None or last[0] != group:
                done += [closed()] if last else []
                last, digest, size = (group,), None, 0
            if line is not None:
                text = "\n" + line if digest else line
                digest = digest or hashlib.md5()
                digest.update(text.encode())
                size += len(text)
        if done:
            yield rows(done)
    if last:
        yield rows([closed()])
