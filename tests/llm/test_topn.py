import random

import pytest
from pyspark.sql import functions as F

from quarrymill.llm.topn import top_n_per_group

ORDER = [("score", True), ("id", False)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_as_by_sorting(spark, partitions):
    rnd = random.Random(5)
    data = [(rnd.choice(["hot"] * 50 + ["b", "c", "", None]), rnd.choice([0.0, -0.0, 1.5, 2.0, None]), i) for i in range(2000)]
    data += data[:300]  # delivered again
    data += [("none", 1.0, None), ("none", 2.0, None)]
    table = spark.createDataFrame([(*d, "x") for d in data], "g string, score double, id bigint, rank_no string")
    found = {(r.id, r.rank_no) for r in top_n_per_group(table, F.col("g"), ORDER, "id", 5, partitions).collect()}
    by = {}
    for g, score, i in set(data[:-2]):
        by.setdefault(g, []).append((score is None, -(score or 0.0), i))
    assert found == {(None, 1)} | {(x[2], n) for own in by.values() for n, x in enumerate(sorted(own)[:5], 1)}


def test_empty(spark):
    assert top_n_per_group(spark.createDataFrame([], "g string, score double, id bigint"), F.col("g"), ORDER, "id", 5).count() == 0


