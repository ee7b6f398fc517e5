import numpy as np
import pytest

from quarrymill.llm.nearest import nearest, pairs
from quarrymill.llm.queries import QUERIES
from quarrymill.session import table
from tests.compare import SF


def brute(data, k=5, size=64):
    ok = {}
    for i, v in data:
        if v is not None and len(v) == size and None not in v and np.isfinite(v).all() and np.any(v):
            ok[i] = np.array(v, float) / np.linalg.norm(v)
    ids = sorted(ok)
    m = np.stack([ok[i] for i in ids])
    out = {}
    for n, i in enumerate(ids):
        s = np.round(m @ m[n], 6)
        s[n] = -9
        best = np.argsort(-s, kind="stable")[:k]
        out[i] = [(ids[b], s[b]) for b in best if s[b] > -9]
    return out


def clustered(n=1200, groups=40, size=64, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    return [(i, (centres[i % groups] + 0.3 * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_and_scores(spark):
    data = clustered()
    data += [(5000 + i, data[3][1]) for i in range(20)] + [(6000, None), (6001, [0.0] * 64), (6002, [1.0] * 63), (6003, [float("nan")] * 64), (6004, [None] + [1.0] * 63), data[7]]
    data.append((6005, (np.array(data[3][1]) * 100).tolist()))
    table_ = spark.createDataFrame([(*d, "x") for d in [*data, (None, data[0][1])]], "vec_id bigint, vec array<float>, rank_no string")
    found = {}
    for r in nearest(table_, entries=100).collect():
        found.setdefault(r.vec_id, []).append((r.rank_no, r.neighbour_id, r.score))
    true = brute(dict(data).items())
    assert set(found) == set(true)
    hit = sum(len({n for _, n, _ in found[i]} & {n for n, _ in own}) for i, own in true.items())
    assert hit / sum(map(len, true.values())) >= 0.95
    for i, own in found.items():
        assert [n for n, _, _ in sorted(own)] == list(range(1, 6)) and i not in {n for _, n, _ in own}
    assert [n for _, n, _ in sorted(found[5010])] == [n for n, _ in true[5010]]  # copies: the smallest ids first


def test_one_partition_is_exact(spark):
    data = clustered(60, 5)
    found = {(r.vec_id, r.neighbour_id) for r in nearest(spark.createDataFrame(data, "vec_id bigint, vec array<float>")).collect()}
    assert found == {(i, n) for i, own in brute(data).items() for n, _ in own}


def test_recall_with_a_hundred_partitions_on_two_levels(spark, monkeypatch):
    from quarrymill.llm import nearest as module

    monkeypatch.setattr(module, "FANOUT", 16)
    data = clustered(4000, 300)
    found = {(r.vec_id, r.neighbour_id) for r in nearest(spark.createDataFrame(data, "vec_id bigint, vec array<float>"), floor=0.02, entries=40, sample_each=20).collect()}
    true = {(i, n) for i, own in brute(data).items() for n, _ in own}
    assert len(found) == len(true) and len(true & found) >= 0.95 * len(true)


def test_a_partition_in_several_blocks_is_searched_whole(spark, monkeypatch):
    from quarrymill.llm import nearest as module

    monkeypatch.setattr(module, "ENTRY_BLOCK", 100)
    monkeypatch.setattr(module, "QUERY_BLOCK", 150)
    data = clustered(700, 20)
    found = {(r.vec_id, r.neighbour_id, r.score) for r in nearest(spark.createDataFrame(data, "vec_id bigint, vec array<float>")).collect()}
    assert found == {(i, n, s) for i, own in brute(data).items() for n, s in own}


def test_more_equal_scores_than_are_looked_at_first(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    data = [(i, (base * (1 + i)).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=64).tolist()) for i in range(40)]
    found = {(r.vec_id, r.rank_no): r.neighbour_id for r in nearest(spark.createDataFrame(data, "vec_id bigint, vec array<float>")).collect()}
    assert [found[30, n] for n in range(1, 6)] == [0, 1, 2, 3, 4] and [found[2, n] for n in range(1, 6)] == [0, 1, 3, 4, 5]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few(spark, n):
    found = nearest(spark.createDataFrame(clustered(max(n, 1), 1)[:n], "vec_id bigint, vec array<float>"))
    assert found.count() == (2 if n == 2 else 0) and pairs(found).count() == (1 if n == 2 else 0)


def test_recall_on_the_given_table(spark):
    data = [(r.vec_id, r.vec) for r in table(spark, SF, "chunk_vectors").collect()]
    true = {(min(i, n), max(i, n)) for i, own in brute(data).items() for n, _ in own}
    found = {(r.vec_lo, r.vec_hi) for r in QUERIES["p3_found"](spark, SF).collect()}
    assert len(true & found) >= 0.99 * len(true)
