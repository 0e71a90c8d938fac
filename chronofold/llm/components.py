"""Connected components of an edge table, by hash-to-min rounds with one shuffle of the edges each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import settled, shuffle_partitions

HUB_LEAST = 200
HUBS_PER_PARTITION = 4


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node of a graph of nodes 0, 1, ... the least node that edges ``a[i], b[i]`` connect it to."""
    root = np.arange(int(max(a.max(), b.max())) + 1)
    while True:
        before = root.copy()
        low = np.minimum(before[a], before[b])
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hangs all that the task's edges connect on its least node; ``new`` marks edges that were not there."""
    held = [pdf[["a", "b", "m"]].to_numpy(np.int64) for pdf in batches if len(pdf)]
    if not held:
        return
    e = np.concatenate(held)
    e = np.concatenate([e[:, :2], e[:, [0, 2]]])
    nodes, at = np.unique(e, return_inverse=True)
    at = at.reshape(e.shape)
    root = roots(at[:, 0], at[:, 1])
    x = np.flatnonzero(root != np.arange(len(root)))
    known = np.unique(at.max(1) * len(nodes) + at.min(1))
    yield pd.DataFrame({"a": nodes[x], "b": nodes[root[x]], "new": ~np.isin(x * len(nodes) + root[x], known)})


def _pairs(edges: DataFrame, size: int) -> DataFrame:
    """Both directions of the edges with their dealing key ``a, salt``. A hub's rows are dealt by a salt; each
    part also gets the hub's least neighbour ``m``, so that parts of a hub hang on the same node. Edges stand
    in the table twice at most, so hubs are HUBS_PER_PARTITION x partitions at most and are broadcast."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if size < HUB_LEAST:
        return both.select("a", "b", F.col("a").alias("m"), F.lit(0).alias("salt"))
    parts = shuffle_partitions(edges.sparkSession)
    fair = max(HUB_LEAST, 2 * size // (HUBS_PER_PARTITION * parts))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"))
    hubs = degree.where(F.col("n") >= fair).select(F.col("a").alias("hub"), F.ceil(F.col("n") * 2 / fair).alias("parts"), "least")
    dealt = both.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    salt = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int")
    return dealt.select("a", "b", F.coalesce("least", "a").alias("m"), salt.alias("salt"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the component's least node) of every node of ``edges`` (``a``, ``b``).

    In each round a node's edges meet in one task, which hangs everything that its edges connect on the least
    node it sees; the rounds end when no task makes a new edge, which is when every node hangs on its root.
    """
    e = settled(edges.where(F.col("a") != F.col("b")).select("a", "b"))
    for _ in range(most_rounds):
        size = e.count()
        if not size:
            break
        dealt = _pairs(e, size).repartition("a", "salt").drop("salt")
        e = settled(dealt.mapInPandas(_contract, "a long, b long, new boolean"))
        if not e.where("new").limit(1).count():
            break
    else:
        raise RuntimeError("components have not settled")
    both = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return both.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
