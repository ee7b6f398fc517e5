"""Cutting texts above a size limit into overlapping pieces at natural boundaries.

Only texts above the limit leave the JVM, each on its own, so the work spreads as the rows do. Two ways to place the
ends share the limit, the overlap and the ranking of boundaries:

* `latest`: each piece reaches as far as the limit lets it and ends at the latest place of the best kind within the
  last half of its range.
* `balanced`: the least number of pieces that the limit allows gets targets of equal length; each target moves to the
  nearest place of the best kind around it, and a piece is added whenever a limit fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of boundary from the strongest on; a piece ends right after one of these strings.
KINDS = (("\n\n",), ("\n",), ("。", "！", "？", "।", "؟", ". ", "! ", "? "), (" ", "　"))
SCHEMA = "piece_no int, start_pos bigint, end_pos bigint"


def pieces(items: DataFrame, keys: list[str], text: str, size: int = 512, overlap: int = 64, placing: str = "latest") -> DataFrame:
    """The columns `keys`, piece_no from 0, start_pos and end_pos of each piece of every text longer than `size`.

    Positions count code points; ends are exclusive. Each piece after the first starts `overlap` before the end of the
    one before. Texts that are null, empty or no longer than `size` give no rows; rows that repeat give their pieces
    again, and rows with null keys theirs; an empty table gives none. Where a range holds no boundary the cut is made at the limit (`latest`) or at the
    target (`balanced`).
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be below half of the size")
    ends = {"latest": latest_ends, "balanced": balanced_ends}[placing]
    long = items.select(*keys, F.col(text).alias("__text")).where(F.length("__text") > size)
    schema = ", ".join([*[f"`{k}` {dict(long.dtypes)[k]}" for k in keys], SCHEMA])
    return long.mapInArrow(_cutter(ends, size, overlap), schema)


def latest_ends(text: str, size: int, overlap: int) -> list[int]:
    ends, start = [], 0
    while len(text) - start > size:
        ends.append(_last(text, start + size // 2 + 1, start + size))
        start = ends[-1] - overlap
    return [*ends, len(text)]


def _last(text: str, low: int, high: int) -> int:
    """The latest end of the best kind of boundary in low..high, else high."""
    for marks in KINDS:
        if (end := max((at + len(m) for m in marks if (at := text.rfind(m, low - len(m), high)) >= 0), default=-1)) >= low:
            return end
    return high


def balanced_ends(text: str, size: int, overlap: int) -> list[int]:
    n, step = len(text), size - overlap
    if n <= size:
        return [n]
    count = -(-(n - overlap) // step)
    while True:
        length = (n + (count - 1) * overlap) / count
        reach = max(0, min(size // 8, int(length - overlap) // 2 - 1))
        ends = [_nearest(text, round((k + 1) * length - k * overlap), reach) for k in range(count - 1)] + [n]
        starts = [0, *[e - overlap for e in ends[:-1]]]
        if all(0 < e - s <= size for s, e in zip(starts, ends)) and all(a < b for a, b in zip(ends, ends[1:])):
            return ends
        count += 1


def _nearest(text: str, target: int, reach: int) -> int:
    """The nearest end to the target of the best kind of boundary within reach, else the target; of two equally near, the first."""
    low, high = target - reach, target + reach
    for marks in KINDS:
        before = max((at + len(m) for m in marks if (at := text.rfind(m, low - len(m), target)) >= 0), default=-1)
        after = min((at + len(m) for m in marks if (at := text.find(m, target - len(m), high)) >= 0), default=-1)
        found = [e for e in (before, after) if low <= e <= high]
        if found:
            return min(found, key=lambda e: abs(e - target))
    return target


def _cutter(ends_of: Callable[[str, int, int], list[int]], size: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, start, end = [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ends = ends_of(text, size, overlap)
                row += [i] * len(ends)
                number += range(len(ends))
                start += [0, *[e - overlap for e in ends[:-1]]]
                end += ends
            taken = [c.take(pa.array(row, pa.int32())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=[*batch.schema.names[:-1], "piece_no", "start_pos", "end_pos"],
            )

    return cut
