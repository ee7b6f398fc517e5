"""The k most similar vectors of every vector, by learned partitions.

A sample of a node's vectors gives a neighbour graph; the graph is cut into balanced partitions, and a softmax classifier
learns which partition a vector belongs to. A partition that still holds more than `entries` vectors is a node in its
turn, with a classifier of its own, so that partitions keep their size however many vectors there are. Every vector is
entered in its most probable partition and looks for its neighbours in every partition that the classifiers give at least
the probability `floor`, where all entries are compared exactly. Models are fitted and applied in tasks, a node each; a
partition beyond a block of entries or queries is searched in blocks. Vectors are shuffled once for each partition they
are looked up in and, but for the sample, never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import bounded_broadcast, written

ENTRY_BLOCK, QUERY_BLOCK, ROUTE_BLOCK = 8192, 24_576, 65_536
FANOUT = 256  # partitions of a node; a node's number has eight bits for each level
DEPTH = 7
ROUTED = "rep bigint, ids array<bigint>, vec array<float>, node bigint, logp float, home boolean"


def usable(vec: Column, size: int) -> Column:
    """`size` finite numbers, not all zero."""
    fit = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) == size) & fit & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 5, size: int = 64, floor: float = 0.06, entries: int = 4096, sample_each: int = 128, seed: int = 7) -> DataFrame:
    """vec_id, neighbour_id, score and rank_no (1 to k) for every usable vector of `vectors` (vec_id, vec).

    score is the cosine rounded to 6 decimals; equal scores go by the smaller neighbour_id. A vector is not its own
    neighbour; an equal vector of another id is. Vectors that aren't usable() or lack an id take no part; an id that
    comes twice counts once, with the vector of the smaller hash; fewer than k + 1 vectors give fewer neighbours, an
    empty table none. A node has at most FANOUT partitions and is fitted on about `sample_each` vectors for each of
    them; every vector is entered and searched. Up to `entries` vectors are one partition.
    """
    spark = vectors.sparkSession
    keyed = vectors.select("vec_id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.reverse("vec")).alias("h2"), F.col("vec").cast("array<float>").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec"), size))
    members = written(keyed.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("vec_id", "h.h1", "h.h2"), "vector-members")
    # Of equal vectors, only the k + 1 least ids can be a neighbour of anything.
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = written(first.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    of_class = members.join(classes, ["h1", "h2"]).select("vec_id", "rep", "h1", "h2")
    own = ["vec_id", "h1", "h2"]
    extra = written(of_class.where("vec_id <> rep").select(*own), "vector-copies")
    several = classes.where(F.size("ids") > 1).select(F.col("rep").alias("vec_id"), "h1", "h2", "ids")
    # What comes again by its id alone (the same row twice, another vector) is left out in the search.
    reps = keyed.join(bounded_broadcast(extra), own, "left_anti").join(bounded_broadcast(several), own, "left")
    reps = reps.select(F.col("vec_id").alias("rep"), F.coalesce("ids", F.array("vec_id")).alias("ids"), "vec", F.lit(0).cast("bigint").alias("node"), F.lit(0.0).cast("float").alias("logp"), F.lit(True).alias("home"), *own[1:])
    count = classes.count()

    share = min(1.0, sample_each / entries)
    drawn = F.pmod(F.xxhash64("h1", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = written(reps.where(drawn).drop("h1", "h2"), "vector-sample")
    routed, estimate = reps.drop("h1", "h2"), sample
    for depth in range(DEPTH):
        held = estimate.where("home").groupBy("node").agg((F.count("*") / share).alias("n")) if depth else spark.createDataFrame([(0, float(count))], "node bigint, n double")
        full = held.withColumn("children", F.least(F.lit(FANOUT), F.ceil(F.col("n") / entries)).cast("int")).where((F.col("n") > 1.5 * entries) & (F.col("children") > 1))
        split = written(full, "nodes")
        if split.isEmpty():
            break
        chance = F.col("children") * sample_each / (F.col("n") * share)
        few = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < (chance * (1 << 30)).cast("bigint")
        fit_on = estimate.where("home").join(bounded_broadcast(split), "node").where(few).select("node", "children", "vec")
        models = written(fit_on.groupBy("node").applyInArrow(_fit(size, seed), "node bigint, weights binary").join(split.select("node", "n"), "node"), "models")
        routed, estimate = _descended(routed, models, size, floor, depth), written(_descended(estimate, models, size, floor, depth), "routed-sample")

    met = _meetings(routed, estimate, share).groupBy("part", "eb", "qb").applyInArrow(_search(k + 1, size), "rep bigint, best array<struct<neg: int, id: bigint>>")
    lists = met.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    hits = lists.join(of_class.select("vec_id", "rep"), "rep").select("vec_id", F.posexplode(F.slice(F.expr("filter(best, x -> x.id <> vec_id)"), 1, k)).alias("at", "hit"))
    return hits.select("vec_id", F.col("hit.id").alias("neighbour_id"), (-F.col("hit.neg") / 1e6).alias("score"), (F.col("at") + 1).alias("rank_no"))


def _descended(rows: DataFrame, models: DataFrame, size: int, floor: float, depth: int) -> DataFrame:
    """The rows of nodes that have a model, sent on to their partitions; the other rows as they are."""
    if depth == 0:  # one model
        return rows.mapInArrow(_route_all(np.frombuffer(models.first()["weights"], np.float32).reshape(size, -1), size, floor), ROUTED)
    salts = written(models.select("node", F.ceil(2 * F.col("n") / ROUTE_BLOCK).cast("int").alias("salts")), "salts")
    model = models.join(salts, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "weights")
    salted = rows.join(bounded_broadcast(salts), "node").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int")).drop("salts")
    sent = salted.groupBy("node", "salt").cogroup(model.groupBy("node", "salt")).applyInArrow(_route_node(size, floor), ROUTED)
    return sent.unionByName(rows.join(bounded_broadcast(salts), "node", "left_anti"))


def _meetings(routed: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """part, eb, qb, role (1 a query, 2 an entry, 3 both), rep, ids and vec: each query beside every entry of its partitions.

    How many blocks a partition needs is estimated from the sample; a block holds a little more or less.
    """
    counts = estimate.groupBy("node").agg(F.count_if("home").alias("entered"), F.count("*").alias("asked"))
    blocks = counts.select("node", *[F.ceil((F.col(n) / share + 1) / most).cast("int").alias(b) for n, most, b in (("entered", ENTRY_BLOCK, "ebs"), ("asked", QUERY_BLOCK, "qbs"))])
    spread = routed.join(bounded_broadcast(written(blocks, "blocks")), "node", "left").fillna(1, ["ebs", "qbs"])
    spread = spread.withColumns({"own_eb": F.pmod(F.xxhash64("rep"), "ebs").cast("int"), "own_qb": F.pmod(F.xxhash64("rep", F.lit(1)), "qbs").cast("int")})
    place = lambda eb, qb, role: F.struct(eb.alias("eb"), qb.alias("qb"), role.alias("role"))
    asks = F.transform(F.sequence(F.lit(0), F.col("ebs") - 1), lambda eb: place(eb, F.col("own_qb"), F.when(F.col("home") & (eb == F.col("own_eb")), 3).otherwise(1)))
    enters = F.transform(F.sequence(F.lit(0), F.col("qbs") - 1), lambda qb: place(F.col("own_eb"), qb, F.lit(2)))
    enters = F.filter(enters, lambda x: F.col("home") & (x["qb"] != F.col("own_qb")))
    sent = spread.select(F.col("node").alias("part"), F.explode(F.concat(asks, enters)).alias("at"), "rep", "ids", "vec")
    ids = F.when((F.col("at.role") >= 2) & (F.size("ids") > 1), F.col("ids"))  # of most entries, the one id is rep
    return sent.select("part", "at.eb", "at.qb", "at.role", "rep", ids.alias("ids"), "vec")


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True, initial=0)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _points(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def _fit(size: int, seed: int):
    def fit(table: pa.Table) -> pa.Table:
        node, children = table["node"][0].as_py(), table["children"][0].as_py()
        points = _points(table["vec"], size).astype(np.float32)
        points = np.unique(points, axis=0)  # the same model whatever order the rows come in
        children = min(children, len(points))
        part = _balanced(points, _graph(points), children)
        weights = _softmax(points, part, children, seed)
        return pa.table({"node": pa.array([node], pa.int64()), "weights": pa.array([np.ascontiguousarray(weights, np.float32).tobytes()], pa.binary())})

    return fit


def _graph(points: np.ndarray, degree: int = 10) -> np.ndarray:
    """The nearest ones of each point, in slabs of some 64 MB at most."""
    out, degree = [], min(degree, len(points) - 1)
    step = max(1, (1 << 24) // max(1, len(points)))
    for low in range(0, len(points), step):
        near = points[low : low + step] @ points.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        out.append(np.argpartition(near, -degree, axis=1)[:, -degree:].astype(np.int32) if degree else np.zeros((len(near), 0), np.int32))
    return np.concatenate(out)


def _balanced(points: np.ndarray, graph: np.ndarray, partitions: int, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A part for each point: halves along the widest direction, then moves that keep more neighbours together."""
    part = np.zeros(len(points), np.int64)

    def halve(own: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[own] = first
            return
        centred = points[own] - points[own].mean(axis=0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        cut = len(own) * (n // 2) // n
        order = own[np.argsort(centred @ axes[:, -1], kind="stable")]
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(points)), 0, partitions)
    if not graph.shape[1]:
        return part
    most = int(np.ceil(slack * len(points) / partitions))
    size = np.bincount(part, minlength=partitions)
    for _ in range(rounds):
        near = part[graph]
        ordered = np.sort(near, axis=1)
        new = np.concatenate((np.ones((len(near), 1), bool), ordered[:, 1:] != ordered[:, :-1]), axis=1)
        length = np.where(new, np.arange(near.shape[1]), 0)
        length = np.arange(near.shape[1]) - np.maximum.accumulate(length, axis=1)
        best = ordered[np.arange(len(near)), length.argmax(axis=1)]
        gain = (near == best[:, None]).sum(axis=1) - (near == part[:, None]).sum(axis=1)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and size[part[i]] > 1:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def _softmax(points: np.ndarray, part: np.ndarray, partitions: int, seed: int, batch: int = 512, epochs: int = 20) -> np.ndarray:
    """Softmax regression, started at the centres of the parts, by Adam on batches."""
    centres = np.zeros((partitions, points.shape[1]), np.float32)
    np.add.at(centres, part, points)
    weights = (20 * centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-6)).T.copy()
    mean, square, step, order = np.zeros_like(weights), np.zeros_like(weights), 0, np.random.default_rng(seed)
    for _ in range(epochs):
        for own in np.array_split(order.permutation(len(points)), max(1, len(points) // batch)):
            logits = points[own] @ weights
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=1, keepdims=True)
            logits[np.arange(len(own)), part[own]] -= 1
            slope = points[own].T @ logits / len(own)
            step += 1
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            weights -= 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return weights


def _children(points: np.ndarray, weights: np.ndarray, logp: np.ndarray, home: np.ndarray, floor: float) -> tuple[np.ndarray, ...]:
    """Which rows go to which partitions, with what logarithm of the probability, and whether that is their home."""
    rows, child, chance, homes = [], [], [], []
    step = max(1, (1 << 22) // weights.shape[1])
    for low in range(0, len(points), step):
        logs = points[low : low + step].astype(np.float32) @ weights
        top = logs.max(axis=1, keepdims=True)
        logs -= top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        logs += logp[low : low + step, None]
        at_home = np.zeros(logs.shape, bool)
        at_home[np.arange(len(logs)), logs.argmax(axis=1)] = home[low : low + step]
        r, c = np.nonzero((logs >= np.log(floor)) | at_home)
        rows.append(r + low)
        child.append(c)
        chance.append(logs[r, c])
        homes.append(at_home[r, c])
    return tuple(np.concatenate(x) for x in (rows, child, chance, homes))


def _sent(rows: pa.RecordBatch | pa.Table, node: int, found: tuple[np.ndarray, ...]) -> list[pa.Array]:
    at, child, chance, home = found
    taken = [rows.column(name).take(pa.array(at, pa.int64())) for name in ("rep", "ids", "vec")]
    return [*taken, pa.array(node * FANOUT + child + 1, pa.int64()), pa.array(chance.astype(np.float32)), pa.array(home)]


NAMES = ["rep", "ids", "vec", "node", "logp", "home"]


def _route_all(weights: np.ndarray, size: int, floor: float):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _children(_points(batch.column("vec"), size), weights, np.zeros(batch.num_rows, np.float32), np.ones(batch.num_rows, bool), floor)
                yield pa.RecordBatch.from_arrays(_sent(batch, 0, found), names=NAMES)

    return route


def _route_node(size: int, floor: float):
    def route(rows: pa.Table, model: pa.Table) -> pa.Table:
        weights = np.frombuffer(model["weights"][0].as_py(), np.float32).reshape(size, -1)
        found = _children(_points(rows["vec"], size), weights, rows["logp"].to_numpy(), rows["home"].to_numpy(), floor)
        return pa.table(_sent(rows, rows["node"][0].as_py() if rows.num_rows else 0, found), names=NAMES)

    return route


def _search(k: int, size: int):
    empty = pa.table({"rep": pa.array([], pa.int64()), "best": pa.array([], pa.list_(pa.struct([("neg", pa.int32()), ("id", pa.int64())])))})

    def search(table: pa.Table) -> pa.Table:
        role, rep = table["role"].to_numpy(), table["rep"].to_numpy()
        entered, asked = (np.flatnonzero(role & bit) for bit in (2, 1))
        others, first = np.unique(rep[entered], return_index=True)  # a row that was delivered twice counts once
        entered = entered[first]
        reps, first = np.unique(rep[asked], return_index=True)
        asked = asked[first]
        if not len(others) or not len(reps):
            return empty
        points = _points(table["vec"], size)
        entry, query = points[entered], points[asked]
        lists = table["ids"].combine_chunks().take(pa.array(entered)).to_pylist()
        copies = {i: np.array(own) for i, own in enumerate(lists) if own}
        return pa.concat_tables(_best(query[low : low + 512], reps[low : low + 512], entry, others, copies, k) for low in range(0, len(reps), 512))

    return search


def _best(query: np.ndarray, reps: np.ndarray, entry: np.ndarray, others: np.ndarray, copies: dict[int, np.ndarray], k: int) -> pa.Table:
    some, neg = _top(query, entry, k)
    owner = np.repeat(np.arange(len(some)), some.shape[1])
    some, neg = some.ravel(), neg.ravel()
    each = others[some]
    if copies and (of_several := np.isin(some, list(copies))).any():  # classes of several ids: all of these, then the first k again
        parts = [(owner[~of_several], neg[~of_several], each[~of_several])]
        for i in np.flatnonzero(of_several):
            own = copies[some[i]]
            parts.append((np.full(len(own), owner[i]), np.full(len(own), neg[i]), own))
        owner, neg, each = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((each, neg, owner))
        owner, neg, each = owner[order], neg[order], each[order]
        keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
        owner, neg, each = owner[keep], neg[keep], each[keep]
    offsets = np.searchsorted(owner, np.arange(len(reps) + 1)).astype(np.int32)
    hits = pa.StructArray.from_arrays([pa.array(neg.astype(np.int32)), pa.array(each.astype(np.int64))], ["neg", "id"])
    return pa.table({"rep": pa.array(reps), "best": pa.ListArray.from_arrays(pa.array(offsets), hits)})


def _top(query: np.ndarray, entry: np.ndarray, k: int, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the k best entries, by cosine to six decimals and place, and minus a million times the cosine.

    Entries are compared in single precision first; the best ones among these exactly, with all that may be equal.
    """
    n, k = len(entry), min(k, len(entry))
    wide = min(n, k + 10)
    score = np.full((len(query), -(-n // width) * width), -9, np.float32)
    np.matmul(query.astype(np.float32), entry.T.astype(np.float32), out=score[:, :n])
    grid = score.reshape(len(query), -1, width)
    groups = grid.max(axis=2)  # the best entries lie in the groups with the best maxima
    if groups.shape[1] > wide:
        groups = np.argpartition(-groups, wide - 1, axis=1)[:, :wide]
        near = np.take_along_axis(grid, groups[:, :, None], 1).reshape(len(query), -1)
        place = (groups[:, :, None] * width + np.arange(width)).reshape(len(query), -1)
    else:
        near, place = score, np.broadcast_to(np.arange(score.shape[1]), score.shape)
    some = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
    least = np.take_along_axis(near, some[:, -1:], 1) if wide < n else np.full((len(query), 1), -9)
    least = np.minimum(least, np.take_along_axis(near, some, 1).min(axis=1, keepdims=True))
    some = np.sort(np.take_along_axis(place, some, 1), axis=1)
    neg = -np.rint(np.einsum("ij,ikj->ik", query, entry[some]) * 1e6).astype(np.int32)
    order = np.argsort(neg, axis=1, kind="stable")[:, :k]  # equal scores: the smaller place
    some, neg = np.take_along_axis(some, order, 1), np.take_along_axis(neg, order, 1)
    if wide < n:
        for i in np.flatnonzero(-neg[:, -1] < least[:, 0] * 1e6 + 3):  # others may be as good as the last one
            whole = -np.rint(entry @ query[i] * 1e6).astype(np.int32)
            some[i] = np.argsort(whole, kind="stable")[:k]
            neg[i] = whole[some[i]]
    return some, neg


def pairs(neighbours: DataFrame) -> DataFrame:
    """vec_lo < vec_hi of every two vectors of which one is a neighbour of the other."""
    return neighbours.select(F.least("vec_id", "neighbour_id").alias("vec_lo"), F.greatest("vec_id", "neighbour_id").alias("vec_hi")).distinct()
