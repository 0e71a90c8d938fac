"""Benchmark decontamination with a broadcast set of test n-grams (DataFrame functions only).

Every item gives its windows of ``n`` consecutive words (an item of fewer words is one
window). The distinct windows, hashed, are the set that the scan probes: each document's
windows are hashed and looked up, so the corpus is neither shuffled nor sorted. What
hits is verified word by word in the same pass, and verified windows mark the words, the
documents and the items.

The set is broadcast only while its windows' words and items take at most
``BROADCAST_CHARS`` characters; beyond that the same join is left to Spark as a shuffled
join, which splits skewed keys. The same goes for the documents that were hit: their
totals, a few numbers each, are broadcast up to ``BROADCAST_DOCS`` of them.

Defined results: a null or wordless document has no words and no hits; wordless items
have no window; repeated items hit together; a repeated document row (same identifier
and text) keeps its own row; an empty benchmark leaves every document clean; further
columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import n_words, settled, table, words

N = 10
BROADCAST_CHARS = 64 << 20
BROADCAST_DOCS = 200_000
SPANS = "array<struct<pos:int,len:int>>"


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: ``len, gram (hash), ngram (words), items (sorted identifiers)``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(benchmark["text"]).alias("w"))
    items = items.where((F.size("w") > 0) & F.col("item").isNotNull())
    size = F.least(F.size("w"), F.lit(n))
    return (
        items.select(
            "item",
            F.explode(
                F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice(F.col("w"), i, size))
            ).alias("ngram"),
        )
        .groupBy("ngram")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.size("ngram").alias("len"), F.xxhash64("ngram").alias("gram"), "ngram", "items")
    )


def verified_hits(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """``_id, _hash, pos, len, items`` of every occurrence of a window. ``docs`` has ``_id, _hash, text``."""
    lengths = [r["len"] for r in windows.select("len").distinct().orderBy("len").collect()]  # at most n values
    each = docs.select("_id", "_hash", words(docs["text"]).alias("w")).where(F.size("w") >= lengths[0])
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - (lengths[0] - 1))).alias("pos"))
    if len(lengths) == 1:
        each = each.withColumn("k", F.lit(lengths[0]))
    else:
        each = each.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("k"))
        each = each.where(F.col("pos") + F.col("k") - 1 <= F.size("w"))
    mine = F.slice("w", F.col("pos"), F.col("k"))
    if small:
        side = F.broadcast(windows)
    else:  # what is shuffled is the window, not the document
        each, side = each.select("_id", "_hash", "pos", "k", mine.alias("mine")), windows
        mine = F.col("mine")
    each = each.join(side, (F.xxhash64(mine) == F.col("gram")) & (F.col("k") == F.col("len")) & (mine == F.col("ngram")))
    return each.select("_id", "_hash", "pos", "len", "items")


def _covered(hits: Column) -> Column:
    """Number of words inside the union of the spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        hits,
        start,
        lambda a, h: F.struct(
            F.greatest(a["end"], h["pos"] + h["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["pos"] + h["len"] - F.greatest(a["end"], h["pos"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def hit_documents(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """``h_id, h_hash, n_hit, n_items, items_sha256, spans`` of the documents with a hit."""
    hits = verified_hits(docs, windows, small).groupBy("_id", "_hash")
    # A document's own windows only; sets, so that repeated rows of a document add nothing.
    found = hits.agg(
        F.array_sort(F.collect_set(F.struct(F.col("pos").alias("pos"), F.col("len").alias("len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.select(
        F.col("_id").alias("h_id"),
        F.col("_hash").alias("h_hash"),
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.transform("spans", lambda c: F.struct((c["pos"] - 1).alias("pos"), c["len"].alias("len"))).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, *, carry: bool = False, spans: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``. ``spans`` adds
    the verified spans (word position from 0, and length), ``carry`` the input row as ``row``."""
    windows = settled(benchmark_windows(benchmark, n))
    chars = windows.agg(F.sum(F.length(F.array_join("ngram", " ")) + F.length(F.array_join("items", " "))).alias("n")).first()["n"]
    rows = docs.select(
        docs["doc_id"].alias("_id"),
        F.xxhash64(docs["text"]).alias("_hash"),
        docs["text"].cast("string").alias("text"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    extra = ["spans"] if spans else []
    if chars is not None:
        found = settled(hit_documents(rows, windows, chars <= BROADCAST_CHARS))
        found = found.select("h_id", "h_hash", "n_hit", "n_items", "items_sha256", *extra)
        # Spans are as many as a document's words, so they are never broadcast.
        few = not spans and found.count() <= BROADCAST_DOCS
        rows = rows.join(
            F.broadcast(found) if few else found,
            rows["_id"].eqNullSafe(found["h_id"]) & (rows["_hash"] == found["h_hash"]),
            "left",
        )
    else:
        for name, kind in (("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("spans", SPANS)):
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(
        F.col("_id").alias("doc_id"),
        n_words(F.col("text")).alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        *([F.coalesce("spans", F.array().cast(SPANS)).alias("spans")] if spans else []),
        *(["row"] if carry else []),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents without a hit, with the columns they had."""
    return decontaminate(docs, benchmark, n, carry=True).where(~F.col("contaminated")).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``doc_id, text``: contaminated documents keep the words outside the verified spans, joined by a
    space; clean ones keep their text as it was (null as empty)."""
    rows = decontaminate(docs, benchmark, n, carry=True, spans=True).withColumn("w", words(F.col("row.text")))
    left = F.filter(
        F.transform(F.col("w"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: ~F.exists("spans", lambda c: (x["i"] >= c["pos"]) & (x["i"] < c["pos"] + c["len"])),
    )
    text = F.when(F.col("contaminated"), F.array_join(F.transform(left, lambda x: x["w"]), " "))
    return rows.select("doc_id", F.coalesce(text, F.col("row.text"), F.lit("")).alias("text"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), h AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
