"""Texts that are alike but for small edits, insertions or reordering, without comparing all pairs.

Each distinct text gets a signature of `chunks * width` symbols of 16 bits: the least hash of its runs of characters in
that many bins (one-permutation hashing), so that two texts differ in a symbol with the probability 1 - similarity.
Signatures are joined by a multi-index Hamming join: two signatures that differ in at most `chunks * (errors + 1) - 1`
symbols have, by pigeonhole, a chunk with no more than `errors` differences. Each chunk is entered once for every choice
of `errors` symbols to leave out, and texts that share an entry are candidates, so that no pair within that distance is
missed. For pairs beyond it the symbols are dealt anew into chunks without errors, a few times. Candidates are thinned by
a sketch (4 bits of each symbol) and compared exactly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.session import bounded_broadcast, dropped, written

_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 18
_EMPTY = np.uint32(0xFFFFFFFF)
PLANES = 4
_PLANE = [f"plane{k}" for k in range(PLANES)]


@lru_cache(1)
def _kept() -> np.ndarray:
    """Which code points stay in a canonical text."""
    return np.array([not (chr(c).isspace() or unicodedata.category(chr(c))[0] == "P") for c in range(0x110000)])


def canonical(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in lower case without white space and punctuation (Unicode P*), and where each begins and ends."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept()[codes]
    before = np.concatenate(([0], np.cumsum(kept)))
    return codes[kept], before[np.cumsum([0, *map(len, lower)])]


def run_hashes(codes: np.ndarray, run: int) -> np.ndarray:
    """A well-mixed 64-bit hash of each run of characters."""
    n = max(0, len(codes) - run + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out *= np.uint64(_BASE)
            out += codes[k : k + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x7FB5D329728EA185)
        out ^= out >> np.uint64(27)
        out *= np.uint64(0x81DADEF4BC2DD44D)
        out ^= out >> np.uint64(33)
    return out


def _signer(run: int, least: int, bins: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                first, chars = at, 0
                while at < len(texts) and (at == first or chars < _SPAN):
                    chars += len(texts[at])
                    at += 1
                codes, bounds = canonical(texts[first:at])
                long = np.flatnonzero(np.diff(bounds) >= least)
                same = [md5(codes[bounds[i] : bounds[i + 1]]).digest() for i in long]
                symbols = _signatures(codes, bounds, run, bins)[long]
                planes = [((symbols >> np.uint32(k) & 1).astype(np.int64) << np.arange(bins)).sum(axis=1) for k in range(PLANES)]
                flat = pa.array((symbols & np.uint32(0xFFFF)).astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(symbols) + 1, dtype=np.int32) * bins), flat)
                rows = pa.array(long + first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(same, pa.binary()), *[pa.array(p, pa.int64()) for p in planes], lists],
                    names=["kind", "id", "same", *_PLANE, "symbols"],
                )

    return sign


def _signatures(codes: np.ndarray, bounds: np.ndarray, run: int, bins: int) -> np.ndarray:
    n, ends = len(bounds) - 1, bounds[1:]
    least = np.full(n * bins, _EMPTY, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for low in range(0, len(codes), _SPAN):
        part = codes[low : low + _SPAN + run - 1]
        hashes = run_hashes(part, run)
        own = owner[low : low + len(hashes)]
        whole = np.arange(low, low + len(hashes)) + run <= ends[own]
        hashes, own = hashes[whole], own[whole]
        where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, own * bins + where, (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    whole_grid = least.reshape(n, bins)
    some = np.flatnonzero((whole_grid != _EMPTY).any(axis=1) & (whole_grid == _EMPTY).any(axis=1))  # a text without any run has nothing to fill from
    grid = whole_grid[some]
    while (empty := grid == _EMPTY).any():  # an empty bin takes the value of the next full one, changed by the distance
        source = np.roll(grid, -1, axis=1)
        grid = np.where(empty & (source != _EMPTY), source * np.uint32(0x9E3779B1) + np.uint32(1), grid)
    whole_grid[some] = grid
    return whole_grid


def signed(texts: DataFrame, run: int, least: int, bins: int) -> DataFrame:
    """kind, id, same (equal for equal canonical texts), sketch and symbols of every text with at least `least` canonical characters."""
    planes = ", ".join(f"{p} bigint" for p in _PLANE)
    long = texts.select("kind", "id", "text").where(F.col("kind").isNotNull() & F.col("id").isNotNull() & (F.length("text") >= max(least, run) // 3))  # lower case makes one character three at most
    return long.mapInArrow(_signer(run, max(least, run), bins), f"kind string, id bigint, same binary, {planes}, symbols array<int>")


def entries(signs: DataFrame, chunks: int, width: int, errors: int, deals: int) -> DataFrame:
    """rep and entry: every chunk of every signature with every choice of `errors` symbols left out, as a 48-bit number.

    `deals` times all symbols are shuffled and give chunks of width - errors symbols, entered whole. rep holds the kind
    in its last bit, and so does the entry.
    """
    places = [[chunk * width + k for k in kept] for chunk in range(chunks) for kept in combinations(range(width), width - errors)]
    for deal in range(deals):
        mixed = np.random.default_rng(deal).permutation(chunks * width)
        places += [mixed[low : low + width - errors].tolist() for low in range(0, len(mixed) - (width - errors) + 1, width - errors)]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column(1).flatten().to_numpy().astype(np.uint64).reshape(batch.num_rows, -1)
            keys = np.empty((batch.num_rows, len(places)), np.uint64)
            for i, kept in enumerate(places):
                keys[:, i] = i + 1
                for place in kept:
                    keys[:, i] = (keys[:, i] ^ symbols[:, place]) * np.uint64(_BASE)
                    keys[:, i] ^= keys[:, i] >> np.uint64(29)
            kind = batch.column(0).to_numpy().astype(np.uint64)[:, None] & np.uint64(1)
            keys = (keys * np.uint64(0x7FB5D329728EA185) >> np.uint64(16) & ~np.uint64(1)) | kind
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(places)), flat)], names=["rep", "entries"])

    return signs.select("rep", "symbols").mapInArrow(enter, "rep bigint, entries array<bigint>").select("rep", F.explode("entries").alias("entry"))


def alike(
    texts: DataFrame,
    similarity: float = 0.6,
    run: int = 10,
    least: int = 200,
    chunks: int = 12,
    width: int = 5,
    errors: int = 1,
    deals: int = 2,
    sketch_distance: int = 38,
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of `texts` with the columns kind ('file' or 'chunk'), id and text, all other columns being ignored.

    members: kind, id and rep, the least id among equal canonical texts of a kind. links: kind, rep_a < rep_b of
    different texts whose sets of character runs have a Jaccard similarity of at least `similarity`. Texts that are
    null, empty or shorter than `least` canonical characters, and rows without kind or id, are in neither; an id that
    comes twice counts once for each different text of it; an empty table gives no rows.

    Two texts at the similarity s differ in a symbol with the probability 1 - s, in 24 of 60 at 0.6. All pairs that differ
    in at most 23 become candidates; beyond, by calculation, all but one in ten thousand at 0.6, and more above. In the
    sketch a symbol differs with the probability 15/16 (1 - s): of pairs at 0.6 fewer than one in thirty thousand have
    more than `sketch_distance` of 60. A signature has at most 63 symbols, as many as the sketch's numbers have bits.
    """
    signs = written(signed(texts, run, least, chunks * width), "signatures")
    reps = signs.groupBy("kind", "same").agg(F.min("id").alias("rep"))
    members = signs.select("kind", "id", "same").join(reps, ["kind", "same"]).select("kind", "id", "rep").distinct()
    distinct = written(signs.join(reps, ["kind", "same"]).where(F.col("id") == F.col("rep")).select("kind", "rep", *_PLANE, "symbols"), "distinct-signatures")

    found = entries(distinct.withColumn("rep", _packed()), chunks, width, errors, deals)
    left, right = found.alias("a"), found.alias("b")
    met = left.join(right, F.col("a.entry") == F.col("b.entry")).where("a.rep < b.rep").select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    sketch = lambda side: distinct.select(_packed().alias(side), *[F.col(p).alias(f"{p}_{side}") for p in _PLANE])
    differ = reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b")) for p in _PLANE])
    near = met.join(sketch("a"), "a").join(sketch("b"), "b").where(F.bit_count(differ) <= sketch_distance)
    pairs = written(near.select("a", "b"), "near-pairs")
    return members, _verified(texts, pairs, similarity, run)


def _packed() -> Column:
    return _pack("kind", "rep")


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float, run: int) -> DataFrame:
    ids = bounded_broadcast(written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "pair-ids"))
    plain = texts.select(F.col("kind"), F.col("id").alias("rep"), "text").select(_packed().alias("rep"), F.col("text").alias("plain")).join(ids, "rep", "left_semi")
    both = (
        bounded_broadcast(pairs).join(plain.select(F.col("rep").alias("a"), F.col("plain").alias("plain_a")), "a")
        .join(plain.select(F.col("rep").alias("b"), F.col("plain").alias("plain_b")), "b")
    )
    checked = both.mapInPandas(_checker(similarity, run), "a bigint, b bigint").distinct()
    kind = F.when(F.col("a") % 2 == 1, "chunk").otherwise("file")
    return checked.select(kind.alias("kind"), F.expr("shiftright(a, 1)").alias("rep_a"), F.expr("shiftright(b, 1)").alias("rep_b"))


def _checker(similarity: float, run: int):
    def runs(texts: pd.Series) -> list[np.ndarray]:
        codes, bounds = canonical(list(texts))
        return [np.unique(run_hashes(codes[a:b], run)) for a, b in zip(bounds, bounds[1:])]

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 256):
                f = frame.iloc[low : low + 256]
                keep = np.zeros(len(f), bool)
                for i, (x, y) in enumerate(zip(runs(f["plain_a"]), runs(f["plain_b"]))):
                    if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                        common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                        keep[i] = common >= similarity * (len(x) + len(y) - common)
                yield f.loc[keep, ["a", "b"]]

    return check


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """kind, id_a < id_b of every two alike rows: links between different texts spread to their copies, and the copies themselves."""
    a = members.select("kind", F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = members.select("kind", F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    linked = links.join(a, ["kind", "rep_a"]).join(b, ["kind", "rep_b"])
    copies = a.join(b.withColumnRenamed("rep_b", "rep_a"), ["kind", "rep_a"]).where("x < y")
    both = linked.select("kind", "x", "y").unionByName(copies.select("kind", "x", "y"))
    return both.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """kind, id, group_id (the least id of all that hang together) and n_links (links of its text to other texts) of every member.

    Connected components by alternating stars: every round links each text to the least one among its greater
    neighbours, then among its smaller ones, until nothing changes. A round is two shuffles of the links, written down;
    their number grows with the logarithm of the longest chain.
    """
    edges = written(links.select(_pack("kind", "rep_a").alias("a"), _pack("kind", "rep_b").alias("b")), "links")
    before = now = None
    while now is None or now != before:
        last, edges = edges, written(_small_star(_large_star(edges)), "stars")
        dropped(last)
        before, now = now, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    roots = edges.select(F.col("b").alias("rep"), F.col("a").alias("root"))
    both = links.select("kind", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("n_links"))
    packed = members.withColumn("packed", _pack("kind", "rep")).join(roots.withColumnRenamed("rep", "packed"), "packed", "left")
    group = F.expr("shiftright(coalesce(root, packed), 1)")
    return packed.join(both, ["kind", "rep"], "left").select("kind", "id", group.alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _pack(kind: str, rep: str) -> Column:
    """kind and id as one number, so that both kinds share a join; ids keep their order within a kind."""
    return F.col(rep) * 2 + (F.col(kind) == "chunk").cast("bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour linked to the least of its neighbour's neighbours (a < b in all links)."""
    ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every text and its smaller neighbours linked to the least of these."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    joined = edges.withColumnRenamed("b", "u").join(least, "u")
    links = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return links.distinct()
