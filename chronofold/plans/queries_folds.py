"""Reservations, spend and reading positions, whose outcomes depend on the outcomes before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import folds as D
from chronofold.plans.queries_admission import R, reports
from chronofold.plans.registry import query
from chronofold.sources.shared import fresh_path
from chronofold.streaming import position as S

ORDER = ["ts", "event_id"]
MAX = {"max_input": 150, "max_output": 400, "max_micro": 120_000_000}

# Views, sign-ups and purchases ask for a hold; clicks settle the last one asked for, errors drop it, and a purchase
# first tells what the last one has really used. The fold itself is a recursive walk.
HOLD_LOG = R + """, a AS (SELECT *, max(CASE WHEN kind IN ('view', 'signup') THEN event_id END) OVER (PARTITION BY book_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id,
 row_number() OVER (PARTITION BY book_id ORDER BY ts, event_id) AS rn FROM l),
g AS (SELECT book_id, rn, event_id, CASE kind WHEN 'click' THEN 'settle' WHEN 'error' THEN 'discard' WHEN 'purchase' THEN 'actual' ELSE 'reserve' END AS op,
 CASE WHEN kind IN ('view', 'signup') THEN event_id ELSE before_id END AS hold, k AS i, k * 3 AS o, micro AS u FROM a),
f AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(0 AS BIGINT) AS si, CAST(0 AS BIGINT) AS so, CAST(0 AS BIGINT) AS su, CAST([] AS STRUCT(h BIGINT, i BIGINT, o BIGINT, u BIGINT)[]) AS holds FROM l
UNION ALL
SELECT book_id, rn, event_id, outcome,
 CAST(si + CASE WHEN outcome = 'settled' THEN mi ELSE 0 END AS BIGINT), CAST(so + CASE WHEN outcome = 'settled' THEN mo ELSE 0 END AS BIGINT), CAST(su + CASE WHEN outcome = 'settled' THEN mu ELSE 0 END AS BIGINT),
 CASE outcome WHEN 'reserved' THEN list_append(holds, struct_pack(h := hold, i := i, o := o, u := u)) WHEN 'noted' THEN list_append(rest, struct_pack(h := hold, i := i, o := o, u := u))
  WHEN 'settled' THEN rest WHEN 'discarded' THEN rest ELSE holds END
FROM (SELECT *, CASE WHEN op = 'reserve' THEN CASE WHEN si + hi + i > 150 THEN 'refused input' WHEN so + ho + o > 400 THEN 'refused output' WHEN su + hu + u > 120000000 THEN 'refused usd' ELSE 'reserved' END
  WHEN op = 'actual' AND hold IS NULL THEN 'invalid' WHEN NOT known THEN 'unknown' WHEN op = 'actual' THEN 'noted' WHEN op = 'settle' THEN 'settled' ELSE 'discarded' END AS outcome
 FROM (SELECT g.book_id, g.rn, g.event_id, g.op, g.hold, g.i, g.o, g.u, f.si, f.so, f.su, f.holds, list_filter(f.holds, lambda x: x.h <> g.hold) AS rest,
   len(list_filter(f.holds, lambda x: x.h = g.hold)) > 0 AS known,
   coalesce(list_sum(list_transform(f.holds, lambda x: x.i)), 0) AS hi, coalesce(list_sum(list_transform(f.holds, lambda x: x.o)), 0) AS ho, coalesce(list_sum(list_transform(f.holds, lambda x: x.u)), 0) AS hu,
   coalesce(list_sum(list_transform(list_filter(f.holds, lambda x: x.h = g.hold), lambda x: x.i)), 0) AS mi, coalesce(list_sum(list_transform(list_filter(f.holds, lambda x: x.h = g.hold), lambda x: x.o)), 0) AS mo,
   coalesce(list_sum(list_transform(list_filter(f.holds, lambda x: x.h = g.hold), lambda x: x.u)), 0) AS mu
  FROM f JOIN g ON g.book_id = f.book_id AND g.rn = f.rn + 1) y) z)
SELECT event_id, outcome, su AS spent_micro, CAST(coalesce(list_sum(list_transform(holds, lambda x: x.u)), 0) AS BIGINT) AS held_micro, CAST(len(holds) AS BIGINT) AS holds FROM f WHERE rn > 0"""


def hold_log(spark, sf):
    asks = F.col("kind").isin("view", "signup")
    before = Window.partitionBy("book_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(asks, F.col("event_id"))).over(before)
    op = F.when(asks, "reserve").when(F.col("kind") == "click", "settle").when(F.col("kind") == "error", "discard").otherwise("actual")
    rows = reports(spark, sf).withColumn("last", last)
    ceilings = [F.lit(v).alias(c) for c, v in MAX.items()]
    return rows.select(
        "book_id", "ts", "event_id", op.alias("op"), F.when(asks, F.col("event_id")).otherwise(F.col("last")).alias("hold_id"),
        F.col("k").alias("input_tokens"), (F.col("k") * 3).alias("output_tokens"), "micro", *ceilings,
    )


@query("cost_reserve_settle", HOLD_LOG, recursive=True)
def cost_reserve_settle(spark, sf):
    """Reports as requests, settlements and corrections of holds under three ceilings a book."""
    return D.reservations(hold_log(spark, sf), ORDER).select("event_id", "outcome", "spent_micro", "held_micro", "holds")


@query("dml_spend_admission", R + """, g AS (SELECT book_id, event_id, micro, row_number() OVER (PARTITION BY book_id ORDER BY ts, event_id) AS rn FROM l),
f AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS spent, '' AS outcome FROM l
UNION ALL SELECT g.book_id, g.rn, g.event_id, spent + CASE WHEN g.book_id % 5 = 0 OR spent + micro <= 300000000 THEN micro ELSE 0 END, CASE WHEN g.book_id % 5 = 0 OR spent + micro <= 300000000 THEN 'spent' ELSE 'refused usd' END
FROM f JOIN g ON g.book_id = f.book_id AND g.rn = f.rn + 1)
SELECT event_id, outcome, spent AS spent_micro FROM f WHERE rn > 0""", recursive=True)
def dml_spend_admission(spark, sf):
    """Reports as spend at once: a refused one adds nothing, so a smaller one after it may still pass. Every fifth book has no ceiling."""
    none = F.lit(None).cast("long")
    ceiling = F.when(F.col("book_id") % 5 != 0, F.lit(300_000_000))
    log = reports(spark, sf).select(
        "book_id", "ts", "event_id", F.lit("spend").alias("op"), F.col("event_id").alias("hold_id"), F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"),
        "micro", none.alias("max_input"), none.alias("max_output"), ceiling.alias("max_micro"),
    )
    return D.reservations(log, ORDER).select("event_id", "outcome", "spent_micro")


# A report of one of three devices: on the version it has seen, some versions back, or a step ahead of all.
DEVICES = """, a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts, event_id) AS rn FROM reports),
g AS (SELECT book_id, rn, event_id, k // 10 AS chapter, k AS "offset", CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS epoch,
 CASE WHEN event_id % 31 = 0 THEN rn + 1 WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(rn / (2 + event_id % 3)) AS BIGINT) END AS base, 'd' || CAST(event_id % 3 AS VARCHAR) AS client FROM a),
f AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS bookmark, CAST(0 AS BIGINT) AS here, CAST(0 AS BIGINT) AS high, '' AS client, CAST(0 AS BIGINT) AS seq FROM reports
UNION ALL
SELECT book_id, rn, event_id, outcome, version + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN greatest(bookmark, chapter) ELSE bookmark END,
 CASE WHEN outcome = 'applied' THEN "offset" WHEN ok THEN greatest(here, "offset") ELSE here END, CASE WHEN ok THEN greatest(high, "offset") ELSE high END, CASE WHEN ok THEN mine ELSE client END, CASE WHEN ok THEN event_id ELSE seq END
FROM (SELECT *, outcome IN ('applied', 'merged_advance', 'tie_won') AS ok FROM (
 SELECT g.book_id, g.rn, g.event_id, g.chapter, g."offset", g.client AS mine, f.version, f.bookmark, f.here, f.high, f.client, f.seq,
  CASE WHEN g.epoch <> 0 THEN 'stale_epoch' WHEN g.base > f.version THEN 'future_version' WHEN g.chapter > 8 THEN 'beyond_end' WHEN g.base = f.version THEN 'applied'
   WHEN g.chapter > f.bookmark OR g."offset" > f.high THEN 'merged_advance' WHEN g.chapter < f.bookmark OR g."offset" < f.high THEN 'stale_behind'
   WHEN g.client > f.client OR g.client = f.client AND g.event_id > f.seq THEN 'tie_won' ELSE 'tie_lost' END AS outcome
 FROM f JOIN g ON g.book_id = f.book_id AND g.rn = f.rn + 1) y) z) """


def devices(spark, sf):
    rn = F.row_number().over(Window.partitionBy("book_id").orderBy(*ORDER)).cast("long")
    rows = reports(spark, sf).withColumn("rn", rn)
    e = F.col("event_id")
    base = F.when(e % 31 == 0, F.col("rn") + 1).when(e % 4 == 0, 0).otherwise(F.floor(F.col("rn") / (2 + e % 3)))
    return rows.select(
        "book_id", "ts", "event_id", F.floor(F.col("k") / 10).alias("chapter"), F.col("k").alias("offset"), F.when(e % 29 == 0, 1).otherwise(0).cast("long").alias("epoch"),
        base.cast("long").alias("base"), F.concat(F.lit("d"), (e % 3).cast("string")).alias("client"), e.alias("sequence"), F.lit(8).cast("long").alias("last_chapter"),
    )


@query("st_device_merge", DEVICES + "SELECT event_id, outcome, version, bookmark, here, high FROM f WHERE rn > 0", recursive=True)
def st_device_merge(spark, sf):
    """Reports of several devices, merged in the order of their arrival."""
    rows = D.merged_positions(devices(spark, sf), ORDER)
    return rows.select("event_id", "outcome", F.col("p_version").alias("version"), F.col("p_bookmark").alias("bookmark"), F.col("p_offset").alias("here"), F.col("p_high_water").alias("high"))


@query("st_device_stream", DEVICES + "SELECT event_id, outcome FROM f WHERE rn > 0", recursive=True)
def st_device_stream(spark, sf):
    """The same as a stream with composite state: the reports' file is read as it arrives."""
    folder = fresh_path(spark, "devices")
    devices(spark, sf).write.parquet(f"{folder}/reports")
    schema = spark.read.parquet(f"{folder}/reports").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/reports")
    return S.run_once(S.device_merge(stream, ORDER), folder, "append").select("event_id", "outcome")
