"""Changing facts without rewriting the past: append change rows, fold them when read.

A change row is ``(fact_id, op, at, recorded_at)`` with op ``assert``, ``end`` or
``retract``. Folding is one aggregate by fact, pre-aggregated before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.sources.shared import settled


def fold_changes(changes: DataFrame) -> DataFrame:
    """``fact_id, revealed_at, invalid_at, retracted_at``: the first assertion, the earliest end, the first retraction."""
    when = lambda op, c: F.min(F.when(F.col("op") == op, F.col(c)))
    return changes.groupBy("fact_id").agg(
        when("assert", "at").alias("revealed_at"), when("end", "at").alias("invalid_at"), when("retract", "recorded_at").alias("retracted_at")
    )


def retract_chapters(tables: dict[str, tuple[DataFrame, str]], retractions: DataFrame) -> DataFrame:
    """``kind, id, retracted_at`` of all that goes with retracted chapters (``book_id, chapter_key, at``): of each table (its rows with
    ``book_id, chapter_key, retracted_at``, and the column of its identifier) the rows that still stand. The earliest of a chapter's retractions counts."""
    at = retractions.groupBy("book_id", "chapter_key").agg(F.min("at").alias("at"))
    each = [
        rows.where("retracted_at is null").join(at, ["book_id", "chapter_key"]).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col("at").alias("retracted_at"))
        for kind, (rows, key) in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), each)


def supersede(versions: DataFrame, by: str, at: str = "at", order: str = "version_id") -> DataFrame:
    """Gap-free versions: each ends where the next of its key starts; empty ones vanish."""
    nxt = F.lead(at).over(Window.partitionBy(by).orderBy(at, order))
    return versions.withColumn("invalid_at", nxt).where(F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col(at)))


def connected(names: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, root`` (the least id) of what shared names (``id, key``) connect. A round passes the least root of
    each name on to all that bear it (minima are pre-aggregated), and then each root's own root; it is
    checkpointed, and the rounds end when no root changes."""
    names = settled(names.select("id", "key").distinct())
    label = names.select("id", F.col("id").alias("root")).distinct()
    for _ in range(most_rounds):
        of_key = names.join(label, "id").groupBy("key").agg(F.min("root").alias("low"))
        low = names.join(of_key, "key").groupBy("id").agg(F.min("low").alias("low"))
        up = label.select(F.col("id").alias("low"), F.col("root").alias("up"))
        step = settled(label.join(low, "id", "left").join(up, "low", "left").select("id", F.least("root", "low", "up").alias("root"), (F.least("root", "low", "up") < F.col("root")).alias("new")))
        label = step.drop("new")
        if not step.where("new").limit(1).count():
            return label
    raise RuntimeError("groups have not settled")


def shortest_paths(edges: DataFrame, start: str, most_hops: int = 6) -> DataFrame:
    """Hops from ``start`` over undirected ``edges`` (``a, b``), breadth-first: each round joins the frontier
    with the edges and keeps the nodes that are new. The number of rounds is bounded by ``most_hops``; edges
    and frontiers are checkpointed, so a round does not unfold the ones before."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, hops int")
    edge_of = seen
    for hop in range(1, most_hops + 1):
        step = edge_of.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        edge_of = settled(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops")))
        seen = seen.unionByName(edge_of)
    return seen
