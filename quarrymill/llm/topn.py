"""The N best rows of every group, by one global sort.

The rows are range-partitioned and sorted on group, score and identifier, so a group of any size spreads over as many
partitions as it fills. Each sorted partition numbers its rows within a group; the counts of the groups that reach over
a partition's start are summed over the partitions before, which turns local numbers into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import written


def top_n_per_group(
    rows: DataFrame,
    group: Column,
    order: list[tuple[str, bool]],
    item: str,
    n: int,
    partitions: int | None = None,
    name: str = "rank_no",
) -> DataFrame:
    """The column `item` and the position (1 to n) of the first n items of each group in the given order.

    `order` names columns and whether each descends; nulls come last, -0.0 equals 0.0. It must end in the item, which
    makes it total. A row that repeats its group's preceding item is the same item
    delivered again and counts once; redeliveries agree in group and order, hence stand side by side. Null is a group
    of its own, and all rows of a group without an item count as one item. An empty table gives no rows. Other columns, whatever their names, are not looked at.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(rows.dtypes)
    keys = [(F.col(c) + 0.0 if kinds[c] in ("float", "double") else F.col(c)).alias(f"__key{i}") for i, (c, _) in enumerate(order)]
    keyed = rows.select(group.alias("__group"), F.col(item).alias("__item"), *keys)
    sort = [F.col("__group").asc()]
    for i, (_, descends) in enumerate(order):
        sort.append(F.col(f"__key{i}").desc_nulls_last() if descends else F.col(f"__key{i}").asc_nulls_last())
    placed = keyed.repartitionByRange(partitions, *sort).sortWithinPartitions(*sort).select("__group", "__item", F.spark_partition_id().alias("__part"))
    schema = placed.select("*", F.lit(0).cast("bigint").alias("__local")).schema
    # A row whose local number is past n can't be among the first n of its group.
    kept = written(placed.mapInArrow(_numbered(n), schema), "topn")
    counts = kept.groupBy("__group", "__part").agg(F.count("*").alias("__count"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one group per partition began in an earlier one: no more rows than partitions, whatever the data.
    carried = counts.withColumn("__before", F.sum("__count").over(before)).where("__before > 0").select(F.col("__group").alias("__g"), F.col("__part").alias("__p"), "__before")
    joined = kept.join(F.broadcast(carried), kept["__group"].eqNullSafe(F.col("__g")) & (kept["__part"] == F.col("__p")), "left")
    position = (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("int")
    return joined.select(F.col("__item").alias(item), position.alias(name)).where(F.col(name) <= n)


def _numbered(n: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, 0  # the group and item that the batch before ended in, and the group's items so far
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, items = batch.column(0), batch.column(1)
            code = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
            same = np.concatenate(([last is not None and last[0] == groups[0].as_py()], code[1:] == code[:-1]))
            again = items.dictionary_encode(null_encoding="encode").indices.to_numpy()
            again = same & np.concatenate(([last is not None and last[1] == items[0].as_py()], again[1:] == again[:-1]))
            new = np.cumsum(~again)  # items so far in this batch
            starts = np.flatnonzero(~same)
            base = np.zeros(len(code), np.int64) - (run if same[0] else 0)
            for_each = np.searchsorted(starts, np.arange(len(code)), side="right") - 1
            base[for_each >= 0] = (new[starts] - 1)[for_each[for_each >= 0]]
            local = new - base
            last, run = (groups[-1].as_py(), items[-1].as_py()), int(local[-1])
            keep = pa.array(~again & (local <= n))
            yield pa.RecordBatch.from_arrays([*[c.filter(keep) for c in batch.columns], pa.array(local).filter(keep)], names=["__group", "__item", "__part", "__local"])

    return number
