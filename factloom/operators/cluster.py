"""Evidence grouped by average linkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIMILARITY, PENALTY = 0.72, 0.20


def average_linkage(vectors: np.ndarray, kinds: list[str], cut: float) -> np.ndarray:
    """Cluster numbers by first appearance: the closest two clusters merge while their mean distance is below cut.

    By chains of nearest neighbours: average linkage never brings two clusters nearer than their parts were, so two that are each
    other's nearest may merge at once, and two such at cut or beyond are done. A cluster is the sum of its vectors and a count of its
    kinds, from which all mean distances follow; so memory grows with the members, not with their square.
    """
    names = sorted(set(kinds))
    bad = np.array([[not compatible(a, b) for b in names] for a in names], float).reshape(len(names), len(names))
    sums = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    n = len(sums)
    held, size, parent = np.zeros((n, len(names))), np.ones(n), np.arange(n)
    held[np.arange(n), [names.index(k) for k in kinds]] = 1.0
    live, chain = np.ones(n, bool), []
    start = 0
    while True:
        if not chain:
            start += int(np.argmax(live[start:])) if start < n else 0
            if start >= n or not live[start]:
                break
            chain.append(start)
        i = chain[-1]
        far = np.where(live, 1.0 - (sums @ sums[i]) / (size * size[i]) + PENALTY * (held @ (bad @ held[i])) / (size * size[i]), np.inf)
        far[i] = np.inf
        j = int(np.argmin(far))
        # Of equally near ones the cluster before in the chain, so that it ends.
        if len(chain) > 1 and far[chain[-2]] <= far[j]:
            j = chain[-2]
        if len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            if far[j] < cut:
                a, b = min(i, j), max(i, j)
                sums[a], held[a], size[a] = sums[a] + sums[b], held[a] + held[b], size[a] + size[b]
                live[b], parent[b], start = False, a, min(start, a)
            else:
                live[i] = live[j] = False
        elif not far[j] < cut:
            # Nothing is near enough to this one, nor ever will be.
            live[i] = False
            chain.pop()
        else:
            chain.append(j)
    while ((up := parent[parent]) != parent).any():
        parent = up
    return pd.factorize(parent)[0]


def compatible(a: str, b: str) -> bool:
    numeric = {"quantitative", "numeric"}
    return a == b or a in numeric and b in numeric or "table" in (a, b) and (a in numeric or b in numeric)


def cluster(members: DataFrame, block: str, key: str = "evidence_id", similarity: float = SIMILARITY) -> DataFrame:
    """(block, key, group_id, group_size): average-linkage groups in each block; group_id is the smallest key of the group.

    Clusters of average linkage lie within one component of the pairs nearer than the cut, so blocks that are such
    components, or unions of them, change nothing. A block of any size is one task, whose memory grows with its members. members: block, key, embedding, kind.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(key, kind="stable").reset_index(drop=True)
        labels = average_linkage(np.stack(df["embedding"].to_numpy()).astype(np.float64), df["kind"].tolist(), 1.0 - similarity)
        g = df.groupby(labels)[key]
        return pd.DataFrame({block: df[block], key: df[key], "group_id": g.transform("min"), "group_size": g.transform("size").astype("int32")})

    kind = members.schema[block].dataType.simpleString()
    return members.select(block, key, "embedding", "kind").groupBy(block).applyInPandas(run, f"{block} {kind}, {key} string, group_id string, group_size int")
