"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a uniform 60-bit hash of its identifier. A source whose target is r
times its size is taken floor(r) times whole; the rest is the documents whose hash lies
below a threshold. The threshold comes from histograms, not from a sort: sizes are
summed by source and the hash's leading bits, the bucket that crosses the budget is
found in the running sums of the (at most 4096) buckets, and only that bucket is summed
again by its next bits, until it holds a single hash. The documents of that last hash
take the words that are still missing, in proportion to their sizes. The decision is a
filter on a broadcast threshold, so rows are never sorted or collected, hot source or
not, and a rerun takes the same words.

The table of sources (one row each: a dimension, not data) goes through the driver,
which checks that there are at most ``MAX_SOURCES``.

Defined results: a null text has size 0; null is a source of its own, last in order;
wordless documents take nothing; repeated rows share a hash and split the boundary in
proportion; an empty table gives an empty result; further columns are ignored, or
returned in the struct ``row`` when ``carry`` is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.common import settled, table

LEVEL_BITS = 12
HASH_BITS = 60
MAX_REPEATS = 3
MAX_SOURCES = 1_000_000
SPACE = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], max_repeats: int = MAX_REPEATS) -> list[tuple[str | None, int, float]]:
    """Source, size and target words. Weights 1, 2, 3 repeat in code-point order, null last; a target
    above ``max_repeats`` x size stops there and the excess is shared again by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    weighted = [(s, n, i % 3 + 1) for i, (s, n) in enumerate(order)]
    # The common level is where the capped shares add up to everything: walk sources by cap per weight.
    rest, weight = sum(n for _, n, _ in weighted), sum(w for _, _, w in weighted)
    level = 0.0
    for _, n, w in sorted(weighted, key=lambda x: (x[1] / x[2], x[2])):
        level = rest / weight if weight else 0.0
        if level * w <= max_repeats * n:
            break
        rest, weight = rest - max_repeats * n, weight - w
    return [(s, n, min(float(max_repeats * n), level * w)) for s, n, w in weighted]


def mix_sources(docs: DataFrame, *, max_repeats: int = MAX_REPEATS, carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` (and ``row``)."""
    spark = docs.sparkSession
    sized = docs.select(
        docs["doc_id"],
        F.coalesce(docs["source"], F.lit("")).alias("_source"),
        docs["source"].isNull().alias("_null"),
        F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(SPACE)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10)
        .cast("long")
        .alias("_hash"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    slim = settled(sized.drop("row"))  # a few numbers per document; the texts are read once for it
    by_source = slim.groupBy("_source", "_null").agg(F.sum("size").alias("n"))
    found = by_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = targets([(None if r["_null"] else r["_source"], r["n"]) for r in found], max_repeats)
    budgets = [
        (s or "", s is None, n, t, min(int(t // n), max_repeats) if n else 0, int(t) - min(int(t // n), max_repeats) * n if n else 0)
        for s, n, t in plan
    ]
    schema = T.StructType(
        [
            T.StructField("b_source", T.StringType()),
            T.StructField("b_null", T.BooleanType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("whole", T.LongType()),
            T.StructField("left", T.LongType()),
        ]
    )
    edge = _thresholds(slim, spark.createDataFrame(budgets, schema))
    base = sized if carry else slim
    at = base.join(F.broadcast(edge), (base["_source"] == edge["b_source"]) & (base["_null"] == edge["b_null"]), "left")
    extra = (
        F.when(F.col("_hash") < F.col("edge"), F.col("size"))
        .when(
            (F.col("_hash") == F.col("edge")) & (F.col("edge_size") > 0),
            F.floor(F.col("size").cast("decimal(19,0)") * F.col("left").cast("decimal(19,0)") / F.col("edge_size")),
        )
        .otherwise(0)
    )
    return at.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"),
        *(["row"] if carry else []),
    )


def _thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds to each source the hash where its budget runs out, ``edge``, the words of the documents with
    that hash, ``edge_size``, and ``left``, the words that those still have to give."""
    key = (slim["_source"] == F.col("b_source")) & (slim["_null"] == F.col("b_null"))
    edges = settled(budgets.withColumn("prefix", F.lit(0).cast("long")).withColumn("edge_size", F.lit(0).cast("long")))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = slim.join(F.broadcast(edges), key).where(
            F.shiftright("_hash", shift + LEVEL_BITS) == F.col("prefix")
        )
        sums = inside.groupBy("b_source", "b_null", F.shiftright("_hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("left").alias("left")
        )
        running = Window.partitionBy("b_source", "b_null").orderBy("bucket")
        crossing = (
            sums.withColumn("upto", F.sum("words").over(running))
            .where(F.col("upto") > F.col("left"))
            .groupBy(F.col("b_source").alias("c_source"), F.col("b_null").alias("c_null"))
            .agg(F.min_by(F.struct("bucket", "words", (F.col("left") - F.col("upto") + F.col("words")).alias("rest")), "bucket").alias("c"))
        )
        joined = edges.join(
            crossing, (F.col("b_source") == F.col("c_source")) & (F.col("b_null") == F.col("c_null")), "left"
        )
        edges = settled(
            joined.select(
                "b_source",
                "b_null",
                "source_size",
                "target",
                "whole",
                # No bucket crosses: the budget covers all of them; the edge lies above every hash.
                F.coalesce("c.rest", F.lit(0)).cast("long").alias("left"),
                F.coalesce("c.bucket", F.lit((1 << (HASH_BITS - shift)) - 1)).cast("long").alias("prefix"),
                F.coalesce("c.words", F.lit(0)).cast("long").alias("edge_size"),
            )
        )
    return edges.withColumnRenamed("prefix", "edge")


def take(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their columns, ``taken_words`` and ``copies`` (3 at most; a part of
    a copy counts as one). Columns of the input with these two names give way to them."""
    out = mix_sources(docs, carry=True, **options).where(F.col("taken") > 0)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("taken_words", "copies")]
    return out.select(*own, F.col("taken").alias("taken_words"), copies.alias("copies"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


# The level is found in closed form: the smallest k for which the sources after the k first in order of
# cap per weight, sharing what those leave, stay under their caps.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
w AS (SELECT source, n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(n AS DOUBLE) / w, w) AS k FROM w),
l AS (SELECT o.k, o.n, o.w,
        (SELECT CAST(sum(n) AS BIGINT) FROM o) - coalesce((SELECT CAST(sum(3 * p.n) AS BIGINT) FROM o p WHERE p.k < o.k), 0) AS rest,
        (SELECT CAST(sum(p.w) AS BIGINT) FROM o p WHERE p.k >= o.k) AS weight FROM o),
level AS (SELECT CAST(rest AS DOUBLE) / weight AS level FROM l
          WHERE CAST(rest AS DOUBLE) / weight * w <= 3 * n ORDER BY k LIMIT 1),
t AS (SELECT source, n, least(CAST(3 * n AS DOUBLE), level * w) AS target FROM w, level),
b AS (SELECT source, n, target, CASE WHEN n > 0 THEN least(CAST(floor(target / n) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
c AS (SELECT source, n, target, whole, CAST(floor(target) AS BIGINT) - whole * n AS budget FROM b),
r AS (SELECT d.doc_id, size, n, target, whole, budget,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
        CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS same
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(whole * size + CASE WHEN upto <= budget THEN size
            WHEN upto - same < budget THEN (size * (budget - upto + same)) // same ELSE 0 END AS BIGINT) AS taken
FROM r
"""
