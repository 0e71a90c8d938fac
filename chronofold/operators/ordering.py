"""Ordered operators: chapter bounds, progress, folding, running state, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.sources.shared import settled


def bounds(chapters: DataFrame, length: Column, by: str = "book_id", order: str = "revealed_at") -> DataFrame:
    """Adds the half-open range ``start, end`` of each chapter on its book's line of characters."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chapters.withColumn("end", F.sum(length).over(upto)).withColumn("start", F.col("end") - length)


def completed(bounded: DataFrame, position: Column) -> DataFrame:
    """Per book the chapters that end at or before ``position``."""
    return bounded.groupBy("book_id").agg(F.count_if(F.col("end") <= position).alias("bookmark"))


def frontier(chapters: DataFrame, receipts: DataFrame) -> DataFrame:
    """Per book the last ordinal of the unbroken run of chapters whose receipt matches in key and hash."""
    r = receipts.select("book_id", F.col("ordinal").alias("revealed_at"), F.col("chapter_key").alias("r_key"), F.col("content_hash").alias("r_hash"))
    rows = chapters.join(r, ["book_id", "revealed_at"], "left")
    bad = (~F.col("r_key").eqNullSafe(F.col("chapter_key")) | ~F.col("r_hash").eqNullSafe(F.col("content_hash"))).cast("int")
    run = Window.partitionBy("book_id").orderBy("revealed_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bad", F.sum(bad).over(run))
    return rows.groupBy("book_id").agg(F.coalesce(F.max(F.when(F.col("bad") == 0, F.col("revealed_at"))), F.lit(0)).alias("frontier"))


def debounce(rows: DataFrame, by: str, time: str, gap_seconds: float, tie: str) -> DataFrame:
    """Rows with no later row of the same key within the gap."""
    nxt = F.lead(time).over(Window.partitionBy(by).orderBy(time, tie))
    gap = F.timestamp_diff("MICROSECOND", F.col(time), F.col("_next"))
    return rows.withColumn("_next", nxt).where(F.col("_next").isNull() | (gap > int(gap_seconds * 1_000_000))).drop("_next")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kept_results(used: DataFrame, by: str, at: str, key: str, *, most: int, hours: int) -> DataFrame:
    """A bounded cache: of the entries used within ``hours`` of their group's last use the ``most`` used last;
    ties go to the least ``key``."""
    group = Window.partitionBy(by)
    fresh = used.withColumn("_last", F.max(at).over(group)).where(F.col(at) > F.timestamp_add("HOUR", F.lit(-hours), F.col("_last")))
    return fresh.withColumn("_n", F.row_number().over(group.orderBy(F.desc(at), key))).where(F.col("_n") <= most).drop("_last", "_n")


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with ``n``, from 1 within each ``by`` in ``order`` (whose values differ). Rows are dealt by range, numbered within their
    task and moved by what the tasks before hold of the same key: a few counts, not the key's rows, meet in one place."""
    dealt = settled(rows.repartitionByRange(by, order).withColumn("_task", F.spark_partition_id()))
    held = dealt.groupBy(by, "_task").agg(F.count(F.lit(1)).alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col(by).alias("_by"), F.col("_task").alias("_of"), before.alias("_before"))
    here = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_task").orderBy(order)))
    joined = here.join(held, here[by].eqNullSafe(held["_by"]) & (F.col("_task") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_n") + F.col("_before")).alias("n"))


def multiset_digest(rows: DataFrame, value: str) -> DataFrame:
    """``rows, digest``: two sums over 60 bits each of the values' SHA-256. Sums are made in the tasks, in any order; a value that is there twice counts twice."""
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(F.col(value), 256), at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", part(1), part(16)).alias("digest"))


def pair_quality(clusters: DataFrame, floor: float) -> DataFrame:
    """A clustering (``pred``) against another (``gold``) by pairs: ``tp, fp, fn, precision, recall, f1``, clusters that join several of the
    other (``over_merged``) and such that are spread over several (``fragmented``), and whether f1 reaches ``floor``. Pairs are
    counted from the sizes of the clusters and their intersections; no pair is formed."""
    cells = settled(clusters.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")))
    pairs = lambda df: df.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("v"))
    size = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    gold, pred = size("gold"), size("pred")
    spread = lambda df: df.agg(F.count_if(F.col("parts") > 1).alias("v"))
    named = {"tp": pairs(cells), "g": pairs(gold), "p": pairs(pred), "over_merged": spread(pred), "fragmented": spread(gold)}
    one = reduce(lambda a, b: a.join(b), [df.withColumnRenamed("v", n) for n, df in named.items()])  # five single rows
    one = one.withColumn("precision", F.try_divide("tp", "p")).withColumn("recall", F.try_divide("tp", "g"))
    one = one.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return one.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), "precision", "recall", "f1", "over_merged", "fragmented", F.coalesce(F.col("f1") >= floor, F.lit(False)).alias("passed"))


def multiset_difference(planned: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """``planned, found`` (numbers of rows), ``lost`` and ``extra``: rows of either side, by their ``columns``, that the other has not as often. One
    grouping of both sides; equal tables give zeros in both directions."""
    side = lambda df, a, b: df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).select(*columns, (F.col("n") * a).alias("p"), (F.col("n") * b).alias("f"))
    both = side(planned, 1, 0).unionByName(side(found, 0, 1)).groupBy(*columns).agg(F.sum("p").alias("p"), F.sum("f").alias("f"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total(F.col("p")).alias("planned"), total(F.col("f")).alias("found"), total(F.greatest(F.col("p") - F.col("f"), F.lit(0))).alias("lost"), total(F.greatest(F.col("f") - F.col("p"), F.lit(0))).alias("extra"))
