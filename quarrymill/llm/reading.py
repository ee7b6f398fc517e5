"""Reading level of each document by smoothed unigram language models, one for each level.

The models are fitted on the documents with human labels: first every paragraph has its document's label, then the
paragraphs are told apart by these first models and the models fitted again, as a document may hold prose of several
levels. Each paragraph of the corpus takes the level of the highest posterior likelihood, and a document that of the
greater part of its prose. Titles, code, log lines and footers aren't prose; footers are the short last lines that come
back throughout a source, counted over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.mixing import source_name
from quarrymill.session import written

LEVELS = (1, 2, 3)
_LOG = re.compile(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\[?\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b")
_MARK = re.compile(r"(?:[-*+>|•]|\d{1,3}[.)]|[QA]:)\s+")
_RULE = re.compile(r"[\W_]*$")
# Scripts that part words by blanks give words; the others give pairs of neighbouring characters.
_WORD = re.compile(r"[^\W\d_\u0e00-\u0e7f\u2e80-\U0003ffff]+|[\u0e00-\u0e7f\u2e80-\u2fff\u3005-\u3007\u3031-\uffef\U00020000-\U0003ffff]+")


def footers(documents: DataFrame, share: float = 0.005, least: int = 3, longest: int = 120) -> list[str]:
    """Last lines of at most `longest` characters that at least `share` of some source's documents end in, and at least `least`.

    Other sources make no difference to that; what is a footer in one is one in all. As each document has one last line,
    a source has no more than 1 / share. Documents alike before that line count once. Without a column `source` all
    documents are of one.
    """
    source = F.coalesce(source_name(F.col("source")), F.lit("")) if "source" in documents.columns else F.lit("")
    body = F.rtrim(F.regexp_replace("text", r"\s+$", ""))
    ends = documents.select(source.alias("of"), F.substring_index(body, "\n", -1).alias("line"), body.alias("body")).where((F.length("line") > 0) & (F.length("line") <= longest))
    totals = documents.groupBy(source.alias("of")).agg(F.count("*").alias("total"))
    ends = ends.select("of", "line", F.xxhash64(F.expr("left(body, length(body) - length(line))")).alias("rest"))
    counted = ends.groupBy("of", "line").agg(F.approx_count_distinct("rest").alias("n"), F.count("*").alias("rows")).where(F.col("n") >= least)
    found = counted.join(totals, "of").where(F.col("rows") >= share * F.col("total"))
    return sorted({r.line.strip() for r in found.select("line").distinct().collect()})


def prose(text: str, footer: frozenset[str] = frozenset()) -> list[str]:
    """The paragraphs of prose, without fenced code, log lines, headings, rules, footers and the markers before lines."""
    out, now, fence = [], [], False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith(("```", "~~~")):
            fence = not fence
            line = ""
        elif fence:
            continue
        if not line and now:
            out.append(" ".join(now))
            now = []
        if not line or line[0] == "#" or line in footer or _LOG.match(line):
            continue
        line = _MARK.sub("", line, count=1)
        if not _RULE.match(line):
            now.append(line)
    return [*out, " ".join(now)] if now else out


# What a word's length says, also in languages with few labels.
_SIZES = [f"<{n}>" for n in range(16)]


def tokens(paragraph: str) -> list[str]:
    out = []
    for run in _WORD.findall(paragraph.lower()):
        if run[0] < "\u0e00" or "\u0e7f" < run[0] < "\u2e80":
            out += (run, _SIZES[min(len(run), 15)])
        elif len(run) > 1:
            out += map("".join, zip(run, run[1:]))
        else:
            out.append(run)
    return out


class Model:
    """Logarithms of each token's probability by level; tokens it hasn't seen in `least` documents tell nothing."""

    def __init__(self, counts: pa.Table, smoothing: float) -> None:
        names, n = counts["token"].to_pylist(), np.stack([counts[f"n{k}"].to_numpy() for k in LEVELS], axis=1).astype(float)
        total = n.sum(axis=0)
        logs = np.log((n + smoothing) / (total + smoothing * max(1, len(names))))
        self.adds = dict(zip(names, map(tuple, logs.tolist())))
        self.runs: dict[str, tuple[float, float, float]] = {}
        self.prior = np.log((total + 1) / (total.sum() + len(LEVELS)))

    def best(self, paragraph: str) -> int:
        """The place of the level of the highest posterior likelihood. What a run of letters adds to each is kept for the next time."""
        one, two, three = self.prior.tolist()
        if len(self.runs) > 200_000:
            self.runs.clear()
        for run in _WORD.findall(paragraph.lower()):
            adds = self.runs.get(run)
            if adds is None:
                a = b = c = 0.0
                for token in tokens(run):
                    if held := self.adds.get(token):
                        a += held[0]
                        b += held[1]
                        c += held[2]
                adds = a, b, c
                if len(run) <= 24:  # longer ones hardly come again
                    self.runs[run] = adds
            one += adds[0]
            two += adds[1]
            three += adds[2]
        return 0 if one >= two and one >= three else 1 if two >= three else 2


def labelled(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """level and text of at most `most` labelled documents; documents whose labels differ, and labels that aren't levels, are left out."""
    kept = labels.where(F.col("reading_level").isin(*LEVELS) & F.col("doc_id").isNotNull())
    one = kept.groupBy(F.col("doc_id").alias("id")).agg(F.min("reading_level").alias("level"), F.max("reading_level").alias("other")).where("level = other")
    some = one.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "level")
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("level", "text")


def seeded(documents: DataFrame, most: int) -> DataFrame:
    """Without labels: level and text of at most `most` documents, the level by thirds of their characters between end marks."""
    some = documents.select("doc_id", "text").where(F.length("text") > 0).orderBy(F.xxhash64("doc_id")).limit(most)
    scored = some.withColumn("score", F.length("text") / (1 + F.regexp_count("text", F.lit(r"[.!?。！？।؟]"))))
    low, high = scored.approxQuantile("score", [1 / 3, 2 / 3], 0.01) or (0.0, 0.0)
    return scored.select(F.when(F.col("score") <= low, 1).when(F.col("score") <= high, 2).otherwise(3).alias("level"), "text")


def fitted(sample: DataFrame, footer: frozenset[str], smoothing: float = 0.1, least: int = 2, rounds: int = 2) -> Model | None:
    """The models of a sample, whose size bounds their tokens."""
    model = None
    for _ in range(rounds):
        counted = sample.select("level", "text").mapInArrow(_counter(footer, model), "token string, level int, n bigint, docs bigint")
        wide = counted.groupBy("token").agg(*[F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in LEVELS], F.sum("docs").alias("docs"))
        counts = wide.where(F.col("docs") >= least).select("token", *[f"n{k}" for k in LEVELS]).orderBy("token").toArrow()
        if counts.num_rows:
            model = Model(counts, smoothing)
    return model


def reading_levels(documents: DataFrame, labels: DataFrame, most_labelled: int = 50_000) -> DataFrame:
    """doc_id, reading_level and the prose characters of each level of every document (doc_id, text) with prose.

    `labels` has doc_id and reading_level; nulls, other numbers and contradicting labels aren't used, and without any
    label the models are seeded by a formula. The models see at most `most_labelled` documents, whose tokens every task holds. Null, blank, code-only
    and log-only texts give no row; ids that repeat, null ones too, give a row each; of equal parts the easier level wins; an empty
    table gives no rows.
    """
    sample = written(labelled(documents, labels, most_labelled), "labelled")
    if sample.isEmpty():
        sample = written(seeded(documents, most_labelled), "seeded")
    footer = frozenset(footers(documents))
    model = fitted(sample, footer)
    return documents.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(_leveller(model, footer), "doc_id bigint, reading_level int, prose_1 bigint, prose_2 bigint, prose_3 bigint")


def _counter(footer: frozenset[str], model: Model | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for level, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met = set()
                for paragraph in prose(text, footer):
                    own = level if model is None else LEVELS[model.best(paragraph)]
                    for token in tokens(paragraph):
                        held = sums.setdefault((token, own), [0, 0])
                        held[0] += 1
                        if token not in met:
                            met.add(token)
                            held[1] += 1
            if len(sums) > 1_000_000:  # partial sums: the rest is added up after the shuffle
                yield _sums(sums)
                sums = {}
        yield _sums(sums)

    return count


def _sums(sums: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in sums], pa.string()), pa.array([k for _, k in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([d for _, d in sums.values()], pa.int64())],
        names=["token", "level", "n", "docs"],
    )


def _leveller(model: Model | None, footer: frozenset[str]):
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                part = [0] * len(LEVELS)
                for paragraph in prose(text, footer):
                    best = model.best(paragraph) if model else 0
                    part[best] += len(paragraph)
                if any(part):
                    rows.append(i)
                    parts.append(part)
            grid = np.array(parts, np.int64).reshape(-1, len(LEVELS))
            names = ["doc_id", "reading_level", *[f"prose_{k}" for k in LEVELS]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(grid.argmax(axis=1).astype(np.int32) + LEVELS[0]), *[pa.array(c) for c in grid.T]], names=names)

    return level
