"""Exact deduplication by sorting content (DataFrame functions only).

Texts are range-partitioned by their bytes: Spark samples splitters over a bounded
key (the first characters and a 64-bit hash, so that the sample on the driver stays
small whatever the texts' length), each task sorts its range externally, equal texts
become neighbours, and the window operator compares neighbouring keys in full.

A text that holds a large share of all rows would make one range too large. Such hot
texts are found with one pre-aggregated count of 64-bit hashes; at most
``HOT_PER_PARTITION`` x partitions can pass the threshold, so the list has a fixed
bound and is broadcast. Their rows get a salt, dealt out row by row, that is part of the
range key, and the salted groups' totals are merged from a pre-aggregated sum over the hot
texts alone.

Defined results: a null text counts as empty; equal empty texts are one group; of
repeated rows (same identifier, same text) one is kept; a null identifier loses
against any other; an empty table gives an empty result; further columns of the input
are ignored, or returned untouched in the struct ``row`` when ``carry`` is set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import settled, shuffle_partitions, table

PREFIX_CHARS = 32
HOT_PER_PARTITION = 4
HOT_LEAST = 64
SALTS = 256


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` (and ``row``)."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # A carried row travels without its text where that is the compared one anyway.
    once = carry and normalise is None and dict(docs.dtypes)[text_col] == "string"
    rest = [c for c in docs.columns if not (once and c == text_col)]
    rows = docs.select(
        docs[id_col].alias("_id"),
        (normalise(body) if normalise else body).alias("_text"),
        docs[text_col].isNull().alias("_null"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_nr"),
        *([F.struct(F.lit(1).alias("_one"), *[docs[c] for c in rest]).alias("_rest")] if carry else []),
    ).withColumn("_hash", F.xxhash64("_text"))

    largest = keep == "largest"
    best = F.max if largest else F.min
    # Null identifiers lose; of equal identifiers in several salts one salt is named.
    rank = F.struct((F.col("_id").isNotNull() if largest else F.col("_id").isNull()).alias("k"), F.col("_id").alias("id"), F.col("_nr").alias("nr"))
    hot = _hot(rows, shuffle_partitions(spark))
    totals = (
        rows.join(F.broadcast(hot), "_hash", "left_semi")
        .groupBy(F.col("_hash").alias("_hot_hash"), F.sha2("_text", 256).alias("_hot_sha"))
        .agg(best(rank).alias("_hot_best"), F.count(F.lit(1)).alias("_hot_size"))
    )

    keyed = (
        rows.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), "_hash", "left")
        .withColumn("_salt", F.when(F.col("_is_hot"), F.col("_nr")).otherwise(-1))
        .withColumn("_prefix", F.substring("_text", 1, PREFIX_CHARS))
        .drop("_is_hot", "_nr")
        .repartitionByRange("_prefix", "_hash", "_salt")
    )
    group = Window.partitionBy("_prefix", "_hash", "_salt", "_text")
    first = F.desc_nulls_last("_id") if largest else F.asc_nulls_last("_id")
    whole = lambda c: F.when(~F.col("_null"), F.col("_text")) if once and c == text_col else F.col("_rest")[c]
    compared = keyed.select(
        "_id",
        "_hash",
        "_salt",
        *([F.struct(*[whole(c).alias(c) for c in docs.columns]).alias("row")] if carry else []),
        F.sha2("_text", 256).alias("_sha"),
        F.row_number().over(group.orderBy(first)).alias("_nth"),
        best("_id").over(group).alias("_group_id"),
        F.count(F.lit(1)).over(group).alias("_group_size"),
    )
    # Hot totals: at most HOT_PER_PARTITION x partitions rows of fixed width, so a broadcast is bounded.
    merged = compared.join(
        F.broadcast(totals),
        (F.col("_salt") >= 0) & (F.col("_hash") == F.col("_hot_hash")) & (F.col("_sha") == F.col("_hot_sha")),
        "left",
    )
    is_hot = F.col("_salt") >= 0
    keep_id = F.when(is_hot, F.col("_hot_best.id")).otherwise(F.col("_group_id"))
    return merged.select(
        F.col("_id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("_hot_size", "_group_size").alias("group_size"),
        ((F.col("_nth") == 1) & F.col("_id").eqNullSafe(keep_id) & (~is_hot | (F.col("_salt") == F.col("_hot_best.nr")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def _hot(rows: DataFrame, partitions: int) -> DataFrame:
    """Hashes of texts with more rows than a fair part of one partition."""
    least = max(HOT_LEAST, rows.count() / (HOT_PER_PARTITION * partitions))
    return settled(
        rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least).select("_hash")
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had."""
    return exact_dedup(docs, carry=True, **options).where("kept").select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
