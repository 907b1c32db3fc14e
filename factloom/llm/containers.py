"""Containers of fixed capacity filled with items: Best-two-fit."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

CAPACITY = 2048
#: Items packed together by one task. Only a group's last container or two can stay badly filled, so more
#: items a group save nothing, and a task's memory is bounded by it.
GROUP_ITEMS = 20_000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes: whole numbers from 1 to capacity.

    A container starts with the largest item left and takes, again and again, the largest that fits its gap. If a
    gap stays, the container's smallest item goes back for the two items left that fill the widened gap best,
    provided they fill it better than it did. Items of one size are taken in their order.
    """
    order = np.argsort(sizes, kind="stable")[::-1]
    at = defaultdict(list)
    for i in order:
        at[int(sizes[i])].append(int(i))  # popped from the end: the first in order comes first
    left = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))  # largest size left up to each size

    def take(size: int) -> int:
        left[size] -= 1
        if not left[size]:
            refresh(size)
        return at[size].pop()

    def refresh(size: int) -> None:
        # Sizes that pointed to this one now point to the next smaller one.
        lower = below[size - 1]
        end = size + int(np.argmax(np.append(below[size:] != size, True)))
        below[size:end] = lower

    def give(size: int, item: int) -> None:
        at[size].append(item)
        left[size] += 1
        if left[size] == 1:
            end = size + int(np.argmax(np.append(below[size:] > size, True)))
            below[size:end] = size

    container = np.full(len(sizes), -1, np.int64)
    bins = 0
    while below[capacity]:
        gap, held = capacity, []
        while gap and (size := int(below[gap])):
            held.append((size, take(size)))
            gap -= size
        if gap and len(held) > 1:
            size, item = held[-1]
            room = gap + size
            first = np.arange(1, room)
            have = left[1:room] > 0
            second = below[room - first]
            # Two of one size need two items left.
            twin = second == first
            second = np.where(twin & (left[1:room] < 2), below[first - 1], second)
            total = np.where(have & (second > 0), first + second, 0)
            best = int(total.argmax()) if len(total) else 0
            if len(total) and total[best] > size:
                a, b = int(first[best]), int(second[best])
                held.pop()
                held += [(a, take(a)), (b, take(b))]
                give(size, item)
        for _, item in held:
            container[item] = bins
        bins += 1
    return container


def fill(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(key, piece_no, start, size, container_id): every unit of every item in exactly one container.

    An item within the capacity stays whole (piece_no 0, start 0). Only a larger one is divided: into full
    containers and a remainder that is packed with the rest. Items of size null, zero or less and null keys are left
    out; a key's repeated rows count once, with the largest size. The empty table gives no rows.

    Items go by a hash of their key into groups of about group_items, which are packed by themselves.
    """
    kind = sizes.schema[key].dataType.simpleString()
    items = written(sizes.where(F.col(key).isNotNull() & (F.col(size) > 0)).groupBy(F.col(key).alias("key")).agg(F.max(F.col(size).cast("bigint")).alias("size")), "sizes")
    full = F.expr(f"size div {capacity}")
    pieces = items.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"greatest(cast(ceil(size / {capacity}) as int) - 1, 0)")), lambda i: F.struct((i * F.lit(capacity)).cast("bigint").alias("start"), F.when(i < full, F.lit(capacity)).otherwise(F.expr(f"size % {capacity}")).cast("bigint").alias("n")))).alias("piece_no", "p"))
    n = items.agg(F.sum(F.expr(f"ceil(size / {capacity})"))).first()[0] or 0
    groups = max(1, math.ceil(n / group_items))
    spread = pieces.select("key", "piece_no", F.col("p.start").alias("start"), F.col("p.n").alias("n"), F.pmod(F.xxhash64("key", "piece_no"), F.lit(groups)).alias("grp"))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["n", "key", "piece_no"], kind="stable")
        df["container_id"] = (df["grp"].to_numpy(np.int64) << 32) | best_two_fit(df["n"].to_numpy(np.int64), capacity)
        return df[["key", "piece_no", "start", "n", "container_id"]]

    packed = spread.groupBy("grp").applyInPandas(pack, f"key {kind}, piece_no int, start bigint, n bigint, container_id bigint")
    return packed.select(F.col("key").alias(key), "piece_no", "start", F.col("n").alias(size), "container_id")


def fullness(filled: DataFrame, size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, units packed, units of room left, and the fewest containers the units could need."""
    a = filled.agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum(size), F.lit(0)).alias("packed"))
    return a.select("containers", "packed", (F.col("containers") * capacity - F.col("packed")).alias("room"), F.ceil(F.col("packed") / capacity).alias("at_least"))
