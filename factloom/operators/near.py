"""Groups of linked nodes by Borůvka hooking, and groups of near vectors from all their pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, written

#: Vectors a block may hold, those that make one block, and the blocks of more than that at least; rows compared at a time.
BLOCK, ALONE, BLOCKS, STRIP = 32_768, 4096, 4, 256
#: Cosines are computed in single precision: pairs this little below the limit are linked too, which only joins components.
SLACK = 1e-5


def _hooks(links: DataFrame) -> DataFrame:
    """(c, p): each component's other end of its smallest link; of two that chose one link, the smaller is a root."""
    edge = F.struct("u", "v").alias("e")
    picks = links.select(F.col("u").alias("c"), edge).unionByName(links.select(F.col("v").alias("c"), edge)).groupBy("c").agg(F.min("e").alias("e"))
    chosen = picks.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"))
    u, v, c = F.col("e.u"), F.col("e.v"), F.col("c")
    rows = F.when(F.col("n") == 2, F.array(F.struct(u.alias("c"), u.alias("p")), F.struct(v.alias("c"), u.alias("p")))).otherwise(F.array(F.struct(c.alias("c"), F.when(c == u, v).otherwise(u).alias("p"))))
    return chosen.select(F.inline(rows))


def _collapse(hooks: DataFrame) -> DataFrame:
    """(c, p) with p the root of c's tree, by pointer doubling: the depth halves in each pass."""
    here = written(hooks, "hooks")
    while True:
        up = here.select(F.col("c").alias("p"), F.col("p").alias("q"))
        twice = here.join(up, "p").select("c", F.col("q").alias("p"))
        top = up.select(F.col("p").alias("q"), F.col("q").alias("r"))
        there = written(twice.join(top, twice["p"] == top["q"]).select("c", F.col("r").alias("p"), (F.col("r") != F.col("p")).alias("moved")), "hooks")
        forget(here)
        here = there.select("c", "p")
        if there.where("moved").isEmpty():
            return here


def group_links(links: DataFrame) -> DataFrame:
    """(node, group_id) for each node of the links (u < v, distinct); group_id is the smallest node linked to it directly or through others.

    Each round, every component takes its smallest outgoing link, the trees that arise collapse by pointer
    doubling, and links are relabelled and deduplicated; components at least halve in a round. Minima are
    combined before each shuffle, so a node with very many links is no hot task; joins that look labels up
    are sort-merge joins whose skewed partitions are split at run time. Without links the result is empty.
    """
    left, rounds = written(links.select("u", "v"), "links"), []
    while not left.isEmpty():
        roots = _collapse(_hooks(left))
        rounds.append(roots)
        a, b = roots.select(F.col("c").alias("u"), F.col("p").alias("a")), roots.select(F.col("c").alias("v"), F.col("p").alias("b"))
        kept = left.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        after = written(kept, "links")
        forget(left)
        left = after
    if not rounds:
        return links.select(F.col("u").alias("node"), F.col("u").alias("group_id")).limit(0)
    # From the last round back: each round's roots are the nodes of the next, so sizes fall by half.
    to = rounds.pop()
    while rounds:
        top = to.select(F.col("c").alias("p"), F.col("p").alias("q"))
        to = rounds.pop().join(top, "p", "left").select("c", F.coalesce("q", "p").alias("p"))
    to = written(to, "roots")
    # Written, so that the join below is of two plain shuffles, whose skewed partitions can be split.
    least = written(to.groupBy("p").agg(F.min("c").alias("group_id")), "least")
    return to.join(least, "p").select(F.col("c").alias("node"), "group_id")


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest node of its component, so far) after the links i to j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up


def tile_labels(x: np.ndarray, y: np.ndarray | None, least: float, strip: int = STRIP) -> np.ndarray:
    """Component labels of the rows of x, then those of y, linked where a row of x and one of y (of x, without y) have a product above least."""
    other, shift = (x, 0) if y is None else (y, len(x))
    label = np.arange(len(x) + (0 if y is None else len(y)))
    for at in range(0, len(x), strip):
        rows = x[at : at + strip]
        i, j = np.divmod(np.flatnonzero(rows @ other.T > least), max(len(other), 1))
        if len(i):
            label = _hook(label, i + at, j + shift)
    return label


def near_links(vectors: DataFrame, key: str, vector: str, cosine: float, block: int = BLOCK, alone: int = ALONE) -> DataFrame:
    """(u, v), u < v, distinct: links whose components are those of all pairs of vectors with a cosine above the given one.

    Every pair is compared: vectors are spread over blocks by a hash of their key, and each pair of blocks is a task. A task
    returns one link a vector at most, to the first of its component there, so dense regions make no more rows than others.
    Vectors have one length; those without a direction are linked to none. The work grows with the square of the rows.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                with np.errstate(invalid="ignore"):
                    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
                    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "v"])

    base = written(vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(unit, f"key {kind}, v binary"), "directions")
    n = base.count()
    blocks = 1 if n <= alone else max(BLOCKS, math.ceil(n / block))
    own = base.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    spread = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = spread.select((F.least("b", "o") * F.lit(blocks).cast("bigint") + F.greatest("b", "o")).alias("tile"), "key", "b", "v")

    def link(group: pa.Table) -> pa.Table:
        b = group.column("b").to_numpy()
        order = np.argsort(b, kind="stable")
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float32).reshape(len(b), -1)[order]
        first, second = divmod(group.column("tile")[0].as_py(), blocks)
        cut = int((b == first).sum())
        with np.errstate(invalid="ignore"):
            label = tile_labels(x[:cut], None if first == second else x[cut:], cosine - SLACK)
        linked = np.flatnonzero(label != np.arange(len(label)))
        keys = group.column("key").combine_chunks().take(pa.array(order))
        return pa.table([keys.take(pa.array(label[linked])), keys.take(pa.array(linked))], ["a", "b"])

    stars = tiles.groupBy("tile").applyInArrow(link, f"a {kind}, b {kind}")
    return stars.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_components(vectors: DataFrame, key: str, vector: str, cosine: float) -> DataFrame:
    """(key, component) of the vectors linked, directly or through others, by cosines above the given one; component is the smallest key. Vectors linked to none are left out."""
    return group_links(near_links(vectors, key, vector, cosine)).select(F.col("node").alias(key), F.col("group_id").alias("component"))
