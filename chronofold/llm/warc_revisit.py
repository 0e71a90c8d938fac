"""Resolving WARC not-modified revisits to the response that they repeat.

A revisit record says that a URL's content had not changed. It is joined as of its time
to the latest earlier full response of the same canonical URL. The match counts only if
the validators agree: where the revisit carries an entity tag it must equal the
response's (weakly: a leading ``W/`` does not matter); else, where it carries a
last-modified date, that must equal the response's; a revisit without either resolves.
The resolved record takes the response's body and headers, updated by those headers of
the revisit that a 304 may change (``MAY_UPDATE``).

The as-of join is a running last value over each URL's captures. A URL may hold a large
share of all captures, at many times or at one, so the captures are range-partitioned by
URL, time and row, with splitters that Spark samples, and each range is a chunk: the
running value is taken inside each URL's part of a chunk, and the last full response of
each part (one row a part) is carried over a URL's parts. An instant that spans parts is
told apart by the last response before it, which is carried too. So no task holds more of
a hot URL than a chunk. Captures without a URL are no part of this.

Defined results: a null URL has no response and stays unresolved; of captures at the
same time the one with the least record identifier comes first, and a full response at
the very time of a revisit is not earlier (of responses at one time the one with the greatest
identifier counts); a null time comes before every other; of repeated rows each is resolved alike; null header maps are empty; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import UPPER, stored, table

# Fields of a 304 that replace the stored response's.
MAY_UPDATE = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme and host A-Z lower-cased and ``www.``, default ports, fragments, tracking parameters and a
    final slash removed, http taken as https, parameters sorted."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.translate(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), UPPER, UPPER.lower())
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), UPPER, UPPER.lower())
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")
    return F.concat(F.when(scheme == "http", "https").otherwise(scheme), F.lit("://"), host, path, tail)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, canonical, capture_time, response_id, status, headers``; ``status``
    is ``resolved``, ``no_response`` or ``validator_mismatch`` (the last two have no ``response_id``).

    ``records``: ``record_id, url, capture_time, kind`` (``response`` or ``revisit``) and ``headers``, a map
    with lower-case names.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "capture_time", "kind", F.coalesce("headers", empty).alias("headers")
    )
    # Captures dealt out by range; what is stored has its chunk for good.
    dealt = rows.where(F.col("canonical").isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("canonical", F.col("capture_time").asc_nulls_first(), "_row")
    rows_in = stored(dealt.drop("_row").withColumn("chunk", F.spark_partition_id()))
    # Instants are numbered inside a part, and the frame ends before the revisit's own instant.
    part = Window.partitionBy("canonical", "chunk")
    timed = rows_in.withColumn("at", F.dense_rank().over(part.orderBy(F.col("capture_time").asc_nulls_first())))
    instant = F.struct(F.col("capture_time").isNotNull().alias("k"), F.col("capture_time").alias("t"))
    response = F.when(F.col("kind") == "response", F.struct(instant.alias("at"), F.col("record_id").alias("id"), F.to_json("headers").alias("h")))
    timed = timed.withColumn("_r", response)
    near = timed.withColumn("before", F.max("_r").over(part.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)))
    # Per part its last response, and the last one of an earlier instant.
    tops = timed.where(F.col("_r").isNotNull()).groupBy("canonical", "chunk", F.col("_r.at").alias("at")).agg(F.max("_r").alias("r"))
    last = tops.withColumn("_nth", F.row_number().over(part.orderBy(F.col("at").desc()))).where("_nth <= 2").groupBy("canonical", "chunk").agg(
        F.max("r").alias("r1"), F.max(F.when(F.col("_nth") == 2, F.col("r"))).alias("r2")
    )
    parts = rows_in.groupBy("canonical", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("canonical").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(last, ["canonical", "chunk"], "left").withColumn("c1", F.max("r1").over(earlier))
    # The last response before the instant of c1: among the parts before, whose instants do not fall.
    other = F.when(F.col("r1.at") < F.col("c1.at"), F.col("r1"))
    carried = carried.withColumn("_new", F.when(F.col("c1").isNotNull() & (F.col("r1.at") > F.col("c1.at")), F.col("c1")))
    carried = carried.withColumn("c2", F.max(F.greatest("_new", "r2", other)).over(earlier))
    carried = carried.where(F.col("c1").isNotNull()).select(F.col("canonical").alias("c_url"), F.col("chunk").alias("c_chunk"), "c1", "c2")
    revisits = near.where(F.col("kind") == "revisit").join(
        carried, (F.col("canonical") == F.col("c_url")) & (F.col("chunk") == F.col("c_chunk")), "left"
    )
    over = F.when(F.col("c1.at") < instant, F.col("c1")).otherwise(F.col("c2"))
    revisits = revisits.withColumn("found", F.greatest("before", over)).select("record_id", "canonical", "capture_time", "headers", "found")
    without = rows.where(F.col("canonical").isNull() & (F.col("kind") == "revisit"))
    revisits = revisits.unionByName(without.select("record_id", "canonical", "capture_time", "headers"), allowMissingColumns=True)
    found = F.col("found")
    theirs = F.from_json(found["h"], "map<string,string>")
    out = revisits.select("record_id", "canonical", "capture_time", "headers", found["id"].alias("_id"), theirs.alias("_h"))
    mine, theirs = F.col("headers"), F.coalesce(F.col("_h"), empty)
    tag = F.try_element_at(mine, F.lit("etag"))
    date = F.try_element_at(mine, F.lit("last-modified"))
    agrees = (
        F.when(tag.isNotNull(), _weak(tag).eqNullSafe(_weak(F.try_element_at(theirs, F.lit("etag")))))
        .when(date.isNotNull(), date.eqNullSafe(F.try_element_at(theirs, F.lit("last-modified"))))
        .otherwise(True)
    )
    status = (
        F.when(F.col("canonical").isNull() | F.col("_id").isNull(), "no_response")
        .when(agrees, "resolved")
        .otherwise("validator_mismatch")
    )
    fresh = F.map_filter(mine, lambda k, v: k.isin(*MAY_UPDATE))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return out.withColumn("status", status).select(
        "record_id",
        "canonical",
        "capture_time",
        F.when(F.col("status") == "resolved", F.col("_id")).alias("response_id"),
        "status",
        F.when(F.col("status") == "resolved", merged).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """The pages as a crawl's records. Pages have no crawl headers, so these follow from the row alone: the
    capture time is the identifier, every page is captured in full and, 1,000 captures later, asked for
    again; the tag is the content's MD5, which one revisit in eleven no longer has."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    day = (F.col("page_id") % 28 + 1).cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        (F.col("page_id") * 2).alias("capture_time"),
        F.lit("response").alias("kind"),
        F.create_map(
            F.lit("etag"), tag, F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("date"), day
        ).alias("headers"),
    )
    seen = F.when(F.col("page_id") % 11 == 0, F.lit("gone")).otherwise(tag)
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        "url",
        (F.col("page_id") * 2 + 2_001).alias("capture_time"),
        F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), seen), F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("r"), day)).alias("headers"),
    )
    return response.unionByName(revisit)


def op3_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    header = lambda k: F.try_element_at("headers", F.lit(k))
    return out.select(
        "record_id",
        "canonical",
        "response_id",
        "status",
        header("etag").alias("etag"),
        header("content-length").alias("content_length"),
        header("date").alias("date"),
    )


ORACLE = r"""
WITH u AS (
  SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS url FROM pages
), s AS (
  SELECT *, translate(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme,
         regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u
), q AS (
  SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS params FROM s
), c AS (
  SELECT page_id, CASE WHEN scheme = 'http' THEN 'https' ELSE scheme END || '://' || host || path ||
         CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical,
         md5(coalesce(html, '')) AS tag, CAST(length(coalesce(html, '')) AS VARCHAR) AS n,
         CAST(page_id % 28 + 1 AS VARCHAR) AS day FROM q
), r AS (
  SELECT v.page_id, v.canonical, v.day, CASE WHEN v.page_id % 11 = 0 THEN 'gone' ELSE v.tag END AS seen,
         max(f.page_id) AS found FROM c v LEFT JOIN c f ON f.canonical = v.canonical AND f.page_id * 2 < v.page_id * 2 + 2001
  GROUP BY ALL
)
SELECT r.page_id * 2 + 1 AS record_id, r.canonical, CASE WHEN f.tag = seen THEN found * 2 END AS response_id,
       CASE WHEN found IS NULL THEN 'no_response' WHEN f.tag = seen THEN 'resolved' ELSE 'validator_mismatch' END AS status,
       CASE WHEN f.tag = seen THEN 'W/' || f.tag END AS etag, CASE WHEN f.tag = seen THEN f.n END AS content_length,
       CASE WHEN f.tag = seen THEN 'r' || r.day END AS date
FROM r LEFT JOIN c f ON f.page_id = r.found
"""
