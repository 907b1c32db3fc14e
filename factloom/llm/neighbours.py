"""The most similar vectors of every vector: HNSW graphs over shards of like vectors, results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import latest, written
from .hnsw import Graph

#: Neighbours, least cosine, numbers in a vector.
K, MIN_COSINE, DIM = 10, 0.75, 128
#: Vectors a shard should hold. A vector is indexed in its nearest shard and in every other to whose centre its distance
#: (one less the cosine) is REACH times that to the nearest at most; it is found, and searches, in all of them.
SHARD, REACH = 2048, 1.08
#: A shard of more than DIVIDED times SHARD vectors is divided by a hash of the keys, each piece searched for all its vectors.
DIVIDED, PIECE = 2, 8
#: Centres are arranged in groups; those of a group are looked at where its own centre is within so many times the nearest group's distance.
GROUP_REACH = 1.5
#: The centroids that shards are made by are fitted on a sample of so many vectors a shard, in all at most SAMPLE.
PER_SHARD, SAMPLE = 64, 100_000
#: A dense region is cut into more shards only if a vector of it would be in so many of them on average at most, and if so
#: many of the nearest pairs of its sample stay together.
MAX_COPIES, KEPT_PAIRS = 3.0, 0.98
EF_SEARCH, EF_PIECES = 16, 64
#: Directions that agree within half of this in every number are copies.
GRID = 1e-5


def unit_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are vectors (dim finite numbers that are not all zero), and those as rows of length one."""
    size = np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)) if len(lists) else np.zeros(0, np.int32)
    right = (size == dim) & np.asarray(lists.is_valid())
    kept = lists.filter(pa.array(right))
    values = kept.flatten()
    x = np.asarray(values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    # Numbers far apart in size are brought to one scale before they are squared.
    with np.errstate(invalid="ignore"):
        most = np.abs(x).max(axis=1, initial=0)
        fine = np.isfinite(x).all(axis=1) & (most > 0)
    x = x[fine] / most[fine, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    right[np.flatnonzero(right)[~fine]] = False
    return right, x.astype(np.float32)


def _nearest_centre(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + rows] @ centres.T, axis=1) for i in range(0, len(x), rows)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres of length one by spherical k-means, from rows spread over x."""
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.linalg.norm(sums, axis=1) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return centres.astype(np.float32)


def _kept(x: np.ndarray, row: np.ndarray, to: np.ndarray, shards: int, least: float, k: int = 5, asks: int = 500) -> float:
    """The share of the k nearest of some rows of x, of a similarity of least or more, that are in a shard with them."""
    some = np.arange(0, len(x), max(1, len(x) // asks))
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -2
    near = np.argpartition(-s, k, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-s, axis=1)[:, : len(x) - 1]
    held = np.zeros((len(x), shards), bool)
    held[row, to] = True
    together = (held[some][:, None, :] & held[near]).any(axis=2)[np.take_along_axis(s, near, 1) >= least]
    return float(together.mean()) if len(together) else 1.0


def shard_centres(sample: np.ndarray, rows: int, shard: int = SHARD, reach: float = REACH, least: float = -1.0) -> np.ndarray:
    """Centres so many that each should own about shard of all rows: few first, and those that own far more are divided again.

    A dense region, a third of all vectors near one direction, say, so gets the shards its size calls for, unless its
    vectors are so evenly far from each other that centres would part near ones: then it stays whole and is divided by a hash.
    """
    want = max(1, math.ceil(rows / shard))
    if want == 1 or len(sample) < 2:
        return sample[:1] if len(sample) else np.zeros((1, DIM), np.float32)
    todo, done = [(_kmeans(sample, min(max(2, math.isqrt(want)), len(sample))), sample)], []
    while todo:
        centres, x = todo.pop()
        own = _nearest_centre(x, centres)
        for c in range(len(centres)):
            part = x[own == c]
            parts = math.ceil(len(part) / len(sample) * rows / shard)
            if parts > DIVIDED and len(part) >= 4 * parts and len(part) < len(x):
                finer = _kmeans(part, parts)
                row, to = Shards(finer, reach).of(part)
                if len(row) <= MAX_COPIES * len(part) and _kept(part, row, to, parts, least) >= KEPT_PAIRS:
                    todo.append((finer, part))
                    continue
            done.append(centres[c])
    return np.stack(done)


class Shards:
    """The centres of all shards in two levels: a vector meets the centres of the groups near it, not all."""

    def __init__(self, centres: np.ndarray, reach: float = REACH) -> None:
        self.centres, self.reach = centres, reach
        self.groups = _kmeans(centres, max(1, math.isqrt(len(centres)))) if len(centres) > 3 else centres[:1]
        own = _nearest_centre(centres, self.groups)
        self.members = [np.flatnonzero(own == g) for g in range(len(self.groups))]

    def of(self, v: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): each row's nearest centre and all others within reach, in the order of rows."""
        out = []
        for at in range(0, len(v), rows):
            x = v[at : at + rows]
            far = 1.0 - x @ self.groups.T
            near = far <= GROUP_REACH * far.min(axis=1, keepdims=True) + 1e-6
            d = np.full((len(x), len(self.centres)), np.inf, np.float32)
            for g, members in enumerate(self.members):
                here = np.flatnonzero(near[:, g]) if len(self.groups) > 1 else np.arange(len(x))
                if len(here) and len(members):
                    d[np.ix_(here, members)] = 1.0 - x[here] @ self.centres[members].T
            row, to = np.nonzero(d <= self.reach * np.maximum(d.min(axis=1, keepdims=True), 1e-6))
            out.append((row + at, to))
        return (np.concatenate([r for r, _ in out]), np.concatenate([t for _, t in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def direction_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits by which equal directions, rounded to GRID, are told: vectors that are multiples of one another are copies."""
    q = np.rint(v / GRID).astype(np.int64)
    odd = np.random.default_rng(5).integers(-(2**62), 2**62, (2, v.shape[1])) | 1
    with np.errstate(over="ignore"):
        return (q * odd[0]).sum(axis=1), (q * odd[1]).sum(axis=1)


def _tiles(shard: np.ndarray, own: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, tile, role) for rows of a shard each: where a shard is whole, its one tile; else, for every piece of it, the tile in which
    the row's own piece is indexed and that piece searches (role 1), and the one that the other way about (role 2); 3 is both."""
    p = pieces[shard]
    at = np.repeat(np.arange(len(shard)), p)
    other = np.arange(len(at)) - np.repeat(np.cumsum(p) - p, p)
    mine = own[at]
    tile = lambda i, j: (shard[at].astype(np.int64) << 32) | (i << 16) | j
    twice = mine != other
    role = np.where(twice, 1, 3).astype(np.int8)
    return np.concatenate([at, at[twice]]), np.concatenate([tile(mine, other), tile(other, mine)[twice]]), np.concatenate([role, np.full(int(twice.sum()), 2, np.int8)])


def nearest(units: DataFrame, key: str = "evidence_id", vector: str = "embedding", k: int = K, min_cosine: float = -1.0, dim: int = DIM, shard: int = SHARD, reach: float = REACH, ef: int = EF_SEARCH, piece: int | None = None) -> DataFrame:
    """(a, b, cosine): b is among the k most similar of a, itself not counted, and their cosine is min_cosine or more.

    Only vectors of dim finite numbers that are not all zero take part. A key's repeated rows count once, with the last
    loaded vector; null keys are left out. Of equally similar vectors the smaller key comes first. Vectors of the
    same direction are indexed once and each takes its own copies first; their pairs come from the k + 1 smallest keys, so
    a group of copies gives at most k pairs a member. No task holds more than some four times shard vectors, or twice
    that where it searches one piece of a divided shard for another.
    """
    spark = units.sparkSession
    piece = piece or PIECE * shard
    rows = units.where(F.size(vector) == dim).select(F.col(key).alias("key"), F.col(vector).alias("v"), *[c for c in units.columns if c == "loaded_at"])
    one = latest(rows if "loaded_at" in rows.columns else rows.withColumn("loaded_at", F.lit(0)), "key").select("key", "v")
    kind = one.schema["key"].dataType.simpleString()

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, v = unit_rows(batch.column(1), dim)
            h1, h2 = direction_keys(v)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(v), [None, pa.py_buffer(np.ascontiguousarray(v))])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right)), data.cast(pa.binary()), pa.array(h1), pa.array(h2)], ["key", "v", "h1", "h2"])

    base = written(one.mapInArrow(direct, f"key {kind}, v binary, h1 bigint, h2 bigint"), "vectors")
    groups = base.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("rep")).where("m > 1")
    copies = written(base.select("key", "h1", "h2").join(groups, ["h1", "h2"]).select("key", "rep", "m"), "copies")
    any_copies = not copies.isEmpty()
    index = base.select("key", "v")
    if any_copies:
        index = index.join(copies.where("key <> rep").select("key"), "key", "left_anti")
    n = index.count()
    # The sample: rows whose key's hash is small, so it is the same in each run; copies count once in it.
    take = min(SAMPLE, max(2000, PER_SHARD * math.ceil(n / shard)))
    part = min(1.0, 1.2 * take / max(n, 1))
    picked = index.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(part * 1_000_000)).select("v").limit(take).toArrow() if n > shard else index.select("v").limit(1).toArrow()
    x = np.frombuffer(b"".join(picked.column("v").to_pylist()), np.float32).reshape(-1, dim)
    placed = spark.sparkContext.broadcast(Shards(shard_centres(x, n, shard, reach, min_cosine) if len(x) else np.eye(1, dim, dtype=np.float32), reach))

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float32).reshape(-1, dim)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(placed.value.centres), np.int64)
        for batch in batches:
            total += np.bincount(placed.value.of(vectors(batch))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["shard", "n"])

    # One number a shard comes to the driver.
    pieces = np.ones(len(placed.value.centres), np.int64)
    if len(pieces) > 1 or n > DIVIDED * shard:
        for r in index.select("v").mapInArrow(tally, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > DIVIDED * shard).collect():
            pieces[r.shard] = math.ceil(r.n / piece)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors(batch)
            row, to = placed.value.of(v)
            own = batch.column("h").to_numpy().astype(np.uint64)[row] % pieces[to].astype(np.uint64)
            at, tile, role = _tiles(to, own.astype(np.int64), pieces)
            at = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(role), batch.column("key").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["tile", "role", "key", "v"])

    def search(group: pa.Table) -> pa.Table:
        # In the order of keys, so that the graph is the same however rows arrive.
        group = group.sort_by("key")
        v = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float32).reshape(-1, dim)
        role = group.column("role").to_numpy()
        inside, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        # Asked for more than k, so that ties at the end can be put in the order of keys.
        if len(inside) == len(v) == len(asks):
            ids, sims = Graph(v).neighbours(k + 2, max(ef, k + 3))
        elif len(inside) and len(asks):
            ids, sims = Graph(np.ascontiguousarray(v[inside])).find(v[asks], k + 2, max(EF_PIECES, k + 3))
        else:
            ids = sims = np.zeros((len(asks), 0), np.int64)
        a, b = np.nonzero((ids >= 0) & (sims >= min_cosine - 1e-4))
        a, to = asks[a], inside[ids[a, b]] if len(inside) else a
        exact = np.einsum("ij,ij->i", v[a].astype(np.float64), v[to].astype(np.float64))
        names = group.column("key").combine_chunks()
        return pa.table([names.take(pa.array(a)), names.take(pa.array(to)), pa.array(exact)], ["a", "b", "cosine"])

    routed = index.withColumn("h", F.xxhash64("key")).mapInArrow(route, f"tile bigint, role tinyint, key {kind}, v binary")
    found = routed.groupBy("tile").applyInArrow(search, f"a {kind}, b {kind}, cosine double").where(F.col("cosine") >= min_cosine)
    # A pair found in several shards counts once; the cosines are equal.
    lists = found.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "b"))), 1, k + 1).alias("near"))
    if not any_copies:
        return lists.select("a", F.inline(F.slice("near", 1, k))).select("a", "b", (-F.col("far")).alias("cosine"))
    return _with_copies(written(lists, "lists"), copies, k)


def _with_copies(lists: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Pairs of all members from the lists of one representative a group: own copies first, then those of near groups."""
    by_rep = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("n") <= k + 1)
    firsts = written(by_rep.groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("firsts"), F.first("m").alias("m")), "firsts")
    own = copies.join(firsts.select("rep", "firsts"), "rep").select(F.col("key").alias("a"), F.explode(F.slice(F.filter("firsts", lambda x: x != F.col("key")), 1, k)).alias("b"), F.lit(1.0).alias("cosine"))
    near = lists.select("a", F.inline("near")).join(firsts.select(F.col("rep").alias("b"), "firsts"), "b", "left").select("a", "far", F.explode(F.coalesce("firsts", F.array("b"))).alias("b"))
    spread = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("far", "b"))).alias("near")).join(firsts.select(F.col("rep").alias("a"), "m"), "a", "left")
    left = spread.select("a", F.coalesce("m", F.lit(1)).alias("m"), F.expr(f"slice(near, 1, cast(greatest({k} + 1 - coalesce(m, 1), 0) as int))").alias("near"))
    members = left.where("m <= %d" % k).join(copies.select(F.col("rep").alias("a"), F.col("key").alias("member")), "a", "left")
    others = members.select(F.coalesce("member", "a").alias("a"), F.inline("near")).select("a", "b", (-F.col("far")).alias("cosine"))
    return own.unionByName(others)


def near_pairs(units: DataFrame, min_cosine: float = MIN_COSINE, k: int = K) -> DataFrame:
    """(evidence_a, evidence_b), smaller id first: pairs of which at least one is among the other's k most similar, of min_cosine or more."""
    found = nearest(units.select("evidence_id", "embedding", "loaded_at"), k=k, min_cosine=min_cosine)
    return found.select(F.least("a", "b").alias("evidence_a"), F.greatest("a", "b").alias("evidence_b")).distinct()
