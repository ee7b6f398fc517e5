"""Evaluation items that stand wholly or partly in the documents of a corpus.

Every run of `stretch` characters (a gram) of an item is a possible seed. One pass over the corpus finds the item grams
in each document by rolling hashes and writes them down; all later steps work on these few rows. Per item the grams
that most documents hold are given up as seeds as long as they cover less than the least share of interest, so that what
holds more always keeps a rarer one. Documents and items that share a seed are aligned (Smith-Waterman, by letters), which
scores edited copies, and the item's characters in common stretches are counted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import bounded_broadcast, written

_OTHER = re.compile(r"[\W_]+")
_BASE = np.uint32(0x9E3779B1)
_WIDE = 0x9E3779B97F4A7C15
_SPAN = 1 << 17  # characters looked at together
MARGIN = 64
TASK_CELLS = 50_000_000  # what one task aligns, about


def letters(text: str | None) -> str:
    """In Unicode form NFKC and lower case, letters and digits only."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text or "").lower())


def _run(span: int) -> tuple[int, int]:
    """Of a stretch of `span` characters, one of the runs of this length that start at multiples of this step lies within it."""
    run = span - span // 2 if span > 16 else span - span // 3
    return run, span - run + 1


def item_table(items: DataFrame, stretch: int, dense_stretch: int, dense_langs: tuple[str, ...]) -> DataFrame:
    """item, span (its stretch), letters, the hashes of its grams, and those of its shorter runs; one row for each different text of an item."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [letters(t) for t in b.column(1).to_pylist()]
            codes, spans = [_codes(t) for t in own], b.column(2).to_pylist()
            grams = [_rolled(c, s).view(np.int64).tolist() for c, s in zip(codes, spans)]
            runs = [_strided(c, _run(s)[0], 1).astype(np.int64).tolist() for c, s in zip(codes, spans)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(own, pa.string()), pa.array(grams, pa.list_(pa.int64())), pa.array(runs, pa.list_(pa.int64()))], names=["item", "span", "letters", "grams", "runs"]
            )

    span = F.when(F.lower(F.trim("lang")).isin(*dense_langs), dense_stretch).otherwise(stretch)
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").alias("item"), "text", span.alias("span"))
    return known.mapInArrow(plain, "item bigint, span int, letters string, grams array<bigint>, runs array<bigint>").where(F.size("grams") > 0).groupBy("item").agg(F.max(F.struct("letters", "span", "grams", "runs")).alias("x")).select("item", "x.*")


def leaks(
    documents: DataFrame,
    items: DataFrame,
    stretch: int = 32,
    dense_stretch: int = 12,
    dense_langs: tuple[str, ...] = ("zh", "ja"),
    share: float = 0.5,
    edited_share: float = 0.25,
    gram_limit: int = 4_000_000,
) -> DataFrame:
    """doc_id, item_id, covered, item_chars, alignment and kind of every document that holds at least `share` of an item, as it is or edited.

    covered counts the item's characters in stretches of at least `stretch` (for items in `dense_langs`:
    `dense_stretch`) characters that occur in the document too, anywhere and in any order; alignment is the local
    alignment score (1 a match, -1 a mismatch or gap) with what lies between the common stretches of the document and
    MARGIN characters around. kind is 'copied' where covered reaches the share of the item's
    characters, and 'edited' where covered reaches `edited_share` and the alignment the share: a copy with words changed,
    put in or left out.
    Texts are compared by letters(). Null and empty texts and items shorter than a stretch match nothing, nor do rows
    without an id; an item_id that comes twice counts with the later of its texts; rows that repeat give a pair once; an empty
    table gives no rows; other columns are not looked at. Hashes of the items go to every task, twelve bytes a
    character, in as many passes as keep each at `gram_limit` characters.
    """
    table = written(item_table(items, stretch, dense_stretch, dense_langs), "items")
    passes = max(1, -(-(table.agg(F.sum(F.size("grams"))).first()[0] or 0) // gram_limit))
    texts = documents.select("doc_id", F.xxhash64("text").alias("copy"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    turn = F.pmod(F.xxhash64("item"), F.lit(passes)).cast("int").alias("turn")
    hits = None
    for k in range(passes):
        own = table.where(turn == k)
        found = texts.mapInArrow(_finder(_hashes(own, "grams"), _hashes(own, "runs")), "doc bigint, copy bigint, near string, grams array<bigint>").withColumn("turn", F.lit(k))
        hits = found if hits is None else hits.unionByName(found)
    hits = written(hits, "leak-hits")

    size = F.length("letters").alias("size")
    places = table.select("item", turn, size, "span", F.posexplode("grams").alias("at", "gram"))
    met = hits.select("doc", "copy", "turn", F.explode("grams").alias("gram")).distinct()
    spread = met.groupBy("gram").agg(F.count_distinct("doc").alias("docs"))
    known = places.join(spread, "gram").groupBy("item").applyInPandas(_rare(min(share, edited_share)), "item bigint, at int, rare boolean")
    matches = met.join(places, ["gram", "turn"]).join(known, ["item", "at"])
    seeded = Window.partitionBy("doc", "copy", "item")
    matches = matches.withColumn("seeded", F.max("rare").over(seeded)).where("seeded")

    before = F.lag("at").over(seeded.orderBy("at"))
    new = F.least(F.col("span"), F.coalesce(F.col("at") - before, F.col("span")))
    covered = matches.select("doc", "copy", "turn", "item", "size", new.alias("new")).groupBy("doc", "copy", "turn", "item", "size").agg(F.sum("new").alias("covered"))
    covered = written(covered.join(hits.select("doc", "copy", "turn", F.length("near").alias("width")).distinct(), ["doc", "copy", "turn"]), "covered")
    # An item in many or long documents is aligned in as many tasks as that takes.
    load = written(covered.groupBy("item").agg(F.sum(F.col("width") * F.col("size")).alias("cells")), "load")
    parts = load.select("item", F.ceil(F.col("cells") / TASK_CELLS).cast("int").alias("parts"))
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (load.agg(F.sum("cells")).first()[0] or 0) // TASK_CELLS)
    split = covered.join(bounded_broadcast(parts), "item").withColumn("part", F.pmod(F.xxhash64("doc", "copy"), "parts"))
    pairs = split.join(hits.select("doc", "copy", "turn", "near").dropDuplicates(["doc", "copy", "turn"]), ["doc", "copy", "turn"]).join(bounded_broadcast(table.select("item", "letters"), 100_000), "item")
    aligned = pairs.select("doc", "item", "covered", "size", "near", "letters", "part").repartition(tasks, "item", "part").sortWithinPartitions("item")
    scored = aligned.mapInPandas(_align, "doc bigint, item bigint, covered bigint, size int, alignment int")
    best = scored.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("covered").alias("covered"), F.max("size").alias("item_chars"), F.max("alignment").alias("alignment"))
    chars = F.col("item_chars")
    edited = (F.col("covered") >= edited_share * chars) & (F.col("alignment") >= share * chars)
    kind = F.when(F.col("covered") >= share * chars, "copied").when(edited, "edited")
    return best.withColumn("kind", kind).where("kind is not null")


def _hashes(table: DataFrame, column: str) -> dict[int, np.ndarray]:
    """The different hashes of each stretch, sorted; no more than gram_limit."""
    rows = table.select("span", F.explode(column).alias("hash")).distinct().toArrow()
    span, hashes = rows["span"].to_numpy(), rows["hash"].to_numpy()
    return {int(k): np.sort(hashes[span == k]) for k in np.unique(span)}


def _rare(share: float):
    def choose(places: pd.DataFrame) -> pd.DataFrame:
        """Of one item's grams that occur at all: which stay seeds. A group holds no more rows than its item has characters."""
        size, span = int(places["size"].iloc[0]), int(places["span"].iloc[0])
        ordered = places.drop_duplicates("at").sort_values(["docs", "at"], ascending=[False, True])
        given, rare = np.zeros(size, bool), []
        for at in ordered["at"]:
            held = given[at : at + span].copy()
            given[at : at + span] = True
            if given.sum() >= share * size:  # from here on a case may hold only what was given up
                given[at : at + span] = held
                rare.append(True)
            else:
                rare.append(False)
        return pd.DataFrame({"item": ordered["item"].to_numpy(), "at": ordered["at"].to_numpy(), "rare": rare})

    return choose


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _strided(codes: np.ndarray, run: int, step: int) -> np.ndarray:
    """Hashes of the runs that start at 0, step, 2 * step ..."""
    n = max(0, (len(codes) - run) // step + 1)
    out = np.zeros(n, np.uint32)
    for k in range(run):
        out *= _BASE
        out += codes[k::step][:n]
    return out * _BASE


def _rolled(codes: np.ndarray, span: int) -> np.ndarray:
    """A 64-bit hash of every run of `span` characters, put together from runs of doubled lengths."""
    n = len(codes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width, power = np.zeros(n, np.uint64), 0, codes.astype(np.uint64), 1, _WIDE
    while True:
        if span & width:
            out = out * np.uint64(power) + block[done : done + n]
            done += width
        if done == span:
            break
        block = block[:-width] * np.uint64(power) + block[width:]
        width, power = 2 * width, power * power % (1 << 64)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x7FB5D329728EA185)
    return out ^ out >> np.uint64(29)


def _finder(grams: dict[int, np.ndarray], runs: dict[int, np.ndarray]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, probes = _letter_table(), []
        for span, own in runs.items():  # looking up few runs shows which texts may hold a gram at all
            coarse = np.zeros(1 << 20, bool)
            coarse[own >> 12] = True
            probes.append((*_run(span), own, coarse))
        for batch in batches:
            texts, out, at = batch.column(2).to_pylist(), [], 0
            while at < len(texts):
                first, group, chars = at, [], 0
                while at < len(texts) and (not group or chars < _SPAN):
                    group.append(_folded(texts[at]))
                    chars += len(group[-1])
                    at += 1
                out += [(first + i, *held) for i, held in _held(group, probes, grams, kept)]
            rows = pa.array([r[0] for r in out], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.list_(pa.int64()))],
                names=["doc", "copy", "near", "grams"],
            )

    return find


def _folded(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().replace("\0", " ")


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """Which code points are letters or digits; 0, which parts the texts of a group, stays too."""
    table = np.array([chr(c).isalnum() for c in range(0x110000)])
    table[0] = True
    return table


def _among(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _held(group: list[str], probes: list, grams: dict[int, np.ndarray], kept: np.ndarray) -> Iterator[tuple[int, tuple[str, np.ndarray]]]:
    """Of each text that holds item grams: its place in the group, the part around them and the grams."""
    codes = _codes("\0".join(group))
    codes = codes[kept[codes]]
    ends = np.append(np.flatnonzero(codes == 0), len(codes))
    touched: set[int] = set()
    for run, step, runs, coarse in probes:
        hashes = _strided(codes, run, step)
        maybe = np.flatnonzero(coarse[hashes >> 12])
        met = maybe[_among(runs, hashes[maybe].astype(np.int64))] * step
        touched.update(np.searchsorted(ends, met).tolist())
    for i in sorted(touched):
        own = codes[ends[i - 1] + 1 if i else 0 : ends[i]]
        low, high, found = len(own), 0, []
        for span, known in grams.items():
            hashes = _rolled(own, span).view(np.int64)
            at = np.flatnonzero(_among(known, hashes))
            if len(at):
                low, high = min(low, int(at[0])), max(high, int(at[-1]) + span)
                found.append(np.unique(hashes[at]))
        if found:
            yield i, (own[max(0, low - MARGIN) : high + MARGIN].tobytes().decode("utf-32-le", "surrogatepass"), np.concatenate(found))


def _align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame = frame.reset_index(drop=True)
        score = np.zeros(len(frame), np.int32)
        for _, own in frame.groupby("item", sort=False):
            letters_of = _codes(own["letters"].iloc[0])
            width = own["near"].str.len().sort_values()
            part: list[int] = []
            for at, w in width.items():  # texts of about one length together, padded to the longest
                if part and w * (len(part) + 1) > 1 << 16:
                    score[part] = _local(letters_of, [_codes(own["near"][i]) for i in part])
                    part = []
                part.append(at)
            score[part] = _local(letters_of, [_codes(own["near"][i]) for i in part])
        yield frame[["doc", "item", "covered", "size"]].assign(alignment=score)


def _local(item: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """The best local alignment score of the item with each text; all texts advance one row of the table at a time."""
    wide = max(map(len, texts))
    small = np.int16 if wide + len(item) < 1 << 14 else np.int32
    grid = np.zeros((len(texts), wide), np.uint32)  # 0 matches no letter
    for row, text in zip(grid, texts):
        row[: len(text)] = text
    slope = np.arange(wide, dtype=small)
    above, best, now = np.zeros((len(texts), wide + 1), small), np.zeros((len(texts), wide), small), np.empty((len(texts), wide), small)
    gains: dict[int, np.ndarray] = {}
    for letter in item.tolist():
        if letter not in gains:
            if len(gains) > 64:
                gains.clear()
            gains[letter] = np.where(grid == letter, small(1), small(-1))
        np.add(above[:, :-1], gains[letter], out=now)
        np.maximum(now, above[:, 1:] - small(1), out=now)
        np.maximum(now, 0, out=now)
        now += slope
        np.maximum.accumulate(now, axis=1, out=now)  # gaps in the item
        now -= slope
        np.maximum(best, now, out=best)
        above[:, 1:] = now
    return best.max(axis=1).astype(np.int32)
