"""Splitting documents into chunks along a ladder of separators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The separators, strongest first; the empty one parts between characters.
LADDER = ("\n\n", "\n", "。", "！", "？", "；", "，", ". ", "! ", "? ", "; ", ", ", " ", "")


Length = Callable[[str], int]


def packed(pieces: list[str], gap: str, size: int, overlap: int, length: Length = len) -> Iterator[str]:
    """Pieces in a row joined up to the size; each chunk after the first begins with the whole pieces that end the one before, up to the overlap."""
    joint = length(gap)
    ends = [0, *accumulate(length(p) + joint for p in pieces)]
    first = 0
    for i in range(1, len(pieces) + 1):
        if i < len(pieces) and ends[i + 1] - ends[first] - joint <= size:
            continue
        yield gap.join(pieces[first:i])
        if i < len(pieces):
            back = i
            while overlap and back > first and ends[i] - ends[back - 1] - joint <= overlap:
                back -= 1
            first = back


def windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Equal windows; the last is the first one that reaches the end."""
    at, step = 0, max(1, size - overlap)
    while True:
        yield text[at : at + size]
        if at + size >= len(text):
            return
        at += step


def forced_windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Equal windows from every start below the length: what becomes of a piece when no separator is left."""
    for at in range(0, len(text), max(1, size - overlap)):
        yield text[at : at + size]


def chunks_of(text: str, size: int, overlap: int, ladder: tuple[str, ...] = LADDER, length: Length = len) -> Iterator[str]:
    """The chunks of a text, by the first separator of the ladder that it holds, oversized pieces by those after it.

    Without any the text is parted between characters. Only a ladder that doesn't end in the empty separator can leave
    an oversized piece with no separator to try; it is cut into forced_windows().
    """
    level = next((i for i, gap in enumerate(ladder) if gap in text), None)
    gap = "" if level is None else ladder[level]
    rest = () if level is None else ladder[level + 1 :]
    if not gap and length is len:
        yield from windows(text, size, overlap)
        return
    for fits, pieces in groupby(text.split(gap) if gap else text, lambda p: length(p) <= size):
        if fits:
            yield from packed(list(pieces), gap, size, overlap, length)
            continue
        for piece in pieces:
            yield from chunks_of(piece, size, overlap, rest, length) if rest else forced_windows(piece, size, overlap)


def split_documents(
    documents: DataFrame, key: str, text: str, size: int = 512, overlap: int = 128, ladder: tuple[str, ...] = LADDER, length: Length = len, carry: tuple[str, ...] = ()
) -> DataFrame:
    """key, chunk_index and text of the chunks of every document, with the columns `carry`; blank chunks are dropped before the numbering.

    `length` measures a text, by default in code points; null and empty texts give no rows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, out = [], [], []
            for i, content in enumerate(batch.column(0).to_pylist()):
                own = [c for c in chunks_of(content, size, overlap, ladder, length) if c.strip()]
                row += [i] * len(own)
                index += range(len(own))
                out += own
            kept = [c.take(pa.array(row, pa.int32())) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(index, pa.int32()), pa.array(out, pa.string())], names=[*batch.schema.names[1:], "chunk_index", "text"])

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry))
    held = documents.select(F.col(text).alias("__text"), key, *carry).where(F.length("__text") > 0)
    return held.mapInArrow(split, f"{schema}, chunk_index int, text string")


def character_windows(documents: DataFrame, key: str, text: str, size: int, overlap: int, reach_end_once: bool = True) -> DataFrame:
    """Windows without looking at separators, as expressions.

    With `reach_end_once` the last window is the first that reaches the end; without it every start below the length has
    a window.
    """
    step = max(1, size - overlap)
    n = F.length(text)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step) * step).cast("int") if reach_end_once else n - 1
    starts = F.sequence(F.lit(0), last, F.lit(step))
    rows = documents.where(n > 0).select(key, F.col(text).alias("__text"), F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select(key, "chunk_index", F.substring("__text", F.col("start") + 1, F.lit(size)).alias("text"))
