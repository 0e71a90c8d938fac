"""Costs, limits, jobs, preferences, marks and other row-level changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import book_profile as P
from chronofold.operators import jobs as J
from chronofold.operators import ledger as L
from chronofold.plans.registry import query
from chronofold.plans.standins import bind
from chronofold.sources import archive as A


def reports(spark, sf):
    """Reports as a ledger; money in whole micro-dollars, so that sums are exact in any order."""
    return bind(spark, sf, "reports").withColumn("micro", F.round(F.col("usd") * 1_000_000).cast("long"))


R = ", l AS (SELECT *, CAST(round(usd * 1000000) AS BIGINT) AS micro FROM reports) "


@query("agg_cost_total", R + "SELECT book_id, CAST(sum(micro) AS BIGINT) AS micro FROM l GROUP BY 1")
def agg_cost_total(spark, sf):
    return reports(spark, sf).groupBy("book_id").agg(F.coalesce(F.sum("micro"), F.lit(0)).alias("micro"))


@query("agg_cost_project", R + """, s AS (SELECT book_id, coalesce(CAST(sum(micro) AS BIGINT), 0) AS m, CAST(sum(k) AS BIGINT) AS i FROM l GROUP BY 1)
SELECT book_id AS request_id, CASE WHEN i + 200 > 3000 + book_id % 7 * 100 THEN 'input' WHEN 2 * i + 500 > 7000 THEN 'output' WHEN m + 1000000 > 3000000000 THEN 'usd' ELSE 'ok' END AS outcome FROM s""")
def agg_cost_project(spark, sf):
    """Ledger, open reservations and one request a book against three ceilings."""
    r = reports(spark, sf).select("book_id", "kind", F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"), "micro")
    asked = r.select("book_id").distinct().select(
        "book_id", F.col("book_id").alias("request_id"), F.lit(200).alias("input_tokens"), F.lit(500).alias("output_tokens"), F.lit(1_000_000).alias("micro"),
        (3_000 + F.col("book_id") % 7 * 100).alias("max_input"), F.lit(7_000).alias("max_output"), F.lit(3_000_000_000).alias("max_micro"),
    )
    return L.projected(asked, r.where("kind <> 'purchase'"), r.where("kind = 'purchase'"))


@query("agg_cost_dedup", "SELECT book_id, k, min(event_id) AS entry_id, CASE WHEN count(DISTINCT kind) > 1 THEN 'conflict' ELSE 'kept' END AS outcome FROM reports GROUP BY 1, 2")
def agg_cost_dedup(spark, sf):
    return L.deduplicated(reports(spark, sf), ["book_id", "k"], F.col("kind"), "event_id").select("book_id", "k", "entry_id", "outcome")


@query("agg_cost_list", R + "SELECT event_id, micro, CAST(sum(micro) OVER (PARTITION BY book_id) AS BIGINT) AS book_micro, CAST(sum(k) OVER (PARTITION BY book_id) AS BIGINT) AS book_tokens FROM l")
def agg_cost_list(spark, sf):
    rows = reports(spark, sf)
    total = rows.groupBy("book_id").agg(F.sum("micro").alias("book_micro"), F.sum("k").alias("book_tokens"))
    return rows.join(total, "book_id").select("event_id", "micro", "book_micro", "book_tokens")


@query("agg_limits", R + ", u AS (SELECT o_custkey, o_orderstatus, (SELECT 1) AS one, l.q FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey) SELECT c_custkey AS owner_id, coalesce((SELECT CAST(sum(micro) AS BIGINT) FROM l WHERE kind <> 'purchase' AND l.book_id = c_custkey), 0) AS spent, coalesce((SELECT CAST(sum(micro) AS BIGINT) FROM l WHERE kind = 'purchase' AND l.book_id = c_custkey), 0) AS reserved, count(*) FILTER (WHERE o_orderstatus <> 'F') AS books, coalesce(CAST(sum(q) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT), 0) AS bytes, count(*) FILTER (WHERE o_orderstatus = 'P') AS jobs FROM customer LEFT JOIN u ON o_custkey = c_custkey GROUP BY 1")
def agg_limits(spark, sf):
    """What every owner uses: orders as books with their bytes, pending ones as active jobs, reports as spend and reservations."""
    books, sources, jobs, owners = library(spark, sf)
    r = reports(spark, sf).select(F.col("book_id").alias("owner_id"), "kind", "micro")
    return J.usage(owners, J.holdings(books, sources, jobs), r.where("kind <> 'purchase'"), r.where("kind = 'purchase'"))


@query("agg_job_progress", "SELECT book_id, count(*) AS total, count(*) FILTER (WHERE r) AS done FROM (SELECT c.book_id, r.chapter_key IS NOT NULL AS r FROM chapters c LEFT JOIN receipts r ON r.book_id = c.book_id AND r.chapter_key = c.chapter_key) x GROUP BY 1")
def agg_job_progress(spark, sf):
    r = bind(spark, sf, "receipts").select("book_id", "chapter_key", F.lit(True).alias("r"))
    rows = bind(spark, sf, "chapters").join(r, ["book_id", "chapter_key"], "left")
    return rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count("r").alias("done"))


HOLDS = ", h AS (SELECT event_id AS hold_id, book_id, k, kind FROM reports WHERE kind IN ('purchase', 'view') AND event_id NOT IN (SELECT event_id - 1 FROM reports WHERE kind = 'click')) "


def holds(spark, sf):
    r = reports(spark, sf)
    log = r.where("kind in ('purchase', 'view')").select(F.col("event_id").alias("hold_id"), "book_id", "k", "kind", F.lit("hold").alias("op"))
    settled = r.where("kind = 'click'").select((F.col("event_id") - 1).alias("hold_id"), "book_id", "k", "kind", F.lit("settle").alias("op"))
    return L.open_holds(log.unionByName(settled))


@query("dml_list_holds", HOLDS + "SELECT hold_id, k FROM h")
def dml_list_holds(spark, sf):
    return holds(spark, sf).orderBy("hold_id").select("hold_id", "k")


@query("dml_reconcile", HOLDS + "SELECT hold_id, kind || '-reconciled-reserved' AS phase, k FROM h")
def dml_reconcile(spark, sf):
    return holds(spark, sf).select("hold_id", F.concat("kind", F.lit("-reconciled-reserved")).alias("phase"), "k")


@query("cost_finalize", "SELECT book_id, k, max(event_id) AS receipt, max(k) OVER (PARTITION BY book_id) AS progress FROM reports GROUP BY book_id, k")
def cost_finalize(spark, sf):
    latest = reports(spark, sf).groupBy("book_id", "k").agg(F.max("event_id").alias("receipt"))
    return latest.withColumn("progress", F.max("k").over(Window.partitionBy("book_id")))


@query("dml_pin_first", ", f AS (SELECT book_id, (list(kind ORDER BY ts, event_id))[1] AS asked, CASE book_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' END AS had FROM reports GROUP BY 1) SELECT book_id, coalesce(had, asked) AS pin, CASE WHEN had IS NULL THEN 'pinned' WHEN had = asked THEN 'kept' ELSE 'conflict' END AS outcome FROM f")
def dml_pin_first(spark, sf):
    """The first report's kind as a book's space; two thirds of the books have one already."""
    r = reports(spark, sf)
    had = F.when(F.col("book_id") % 3 == 0, "view").when(F.col("book_id") % 3 == 1, "click")
    pins = r.select("book_id").distinct().withColumn("space", had).where("space is not null")
    return L.pinned_first(r.select("book_id", F.col("kind").alias("space"), "ts", "event_id"), pins, ["ts", "event_id"])


@query("dml_repin", ", n AS (SELECT book_id, (list(kind ORDER BY ts DESC, event_id DESC))[1] AS space FROM reports GROUP BY 1) SELECT n.book_id, CASE WHEN NOT EXISTS (SELECT 1 FROM reports r WHERE r.book_id = n.book_id AND r.k >= 95 AND r.kind <> n.space) THEN space END AS pin FROM n")
def dml_repin(spark, sf):
    """The last report's kind as a new space; reports of 95 and more are the rows that live."""
    r = reports(spark, sf).withColumn("retracted_at", F.when(F.col("k") < 95, F.col("ts")))
    asked = r.groupBy("book_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("space"))
    return L.repinned(asked, r.select("book_id", F.col("kind").alias("space"), "retracted_at"))


@query("dml_add_chunk", "SELECT chunk_id, CASE WHEN model <> 'model-1' THEN 'wrong model' WHEN len(vec) <> dimension THEN 'wrong dimension' ELSE 'added' END AS outcome FROM chunks")
def dml_add_chunk(spark, sf):
    outcome = F.when(F.col("model") != "model-1", "wrong model").when(F.size("vec") != F.col("dimension"), "wrong dimension").otherwise("added")
    return bind(spark, sf, "chunks").select("chunk_id", outcome.alias("outcome"))


@query("dml_version_guard", "SELECT book_id, max(k) AS stored, CASE WHEN max(k) > 97 THEN 'newer' ELSE 'ok' END AS state FROM reports GROUP BY 1")
def dml_version_guard(spark, sf):
    return reports(spark, sf).groupBy("book_id").agg(F.max("k").alias("stored"), F.when(F.max("k") > 97, "newer").otherwise("ok").alias("state"))


@query("dml_remove_cascade", "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 9 <> 0 GROUP BY 1")
def dml_remove_cascade(spark, sf):
    """A removed owner takes its rows of every table along, children first."""
    gone = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    # An order of an owner outside the table stays; none of the removed owners' does.
    kept = orders.where("o_custkey % 9 <> 0").join(gone, "o_custkey", "left_anti").select("o_orderkey")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return kept.join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("dml_soft_delete", "SELECT event_id, CASE kind WHEN 'click' THEN 'cancelled' WHEN 'view' THEN 'cancel_requested' ELSE kind END AS state FROM reports WHERE book_id % 4 = 0")
def dml_soft_delete(spark, sf):
    state = F.when(F.col("kind") == "click", "cancelled").when(F.col("kind") == "view", "cancel_requested").otherwise(F.col("kind"))
    return reports(spark, sf).where("book_id % 4 = 0").select("event_id", state.alias("state"))


PREFS = "SELECT book_id, kind, (list(k ORDER BY ts DESC, event_id DESC))[1] AS value, count(*) AS version FROM reports GROUP BY 1, 2"


@query("dml_prefs_upsert", PREFS)
@query("dml_mark_update", PREFS)
def dml_prefs_upsert(spark, sf):
    """Latest by key; the version is the number of writes."""
    return reports(spark, sf).groupBy("book_id", "kind").agg(F.max_by("k", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("version"))


@query("dml_mark_delete", "SELECT event_id FROM reports WHERE kind <> 'purchase' AND event_id NOT IN (SELECT event_id + 1 FROM reports WHERE kind = 'purchase')")
def dml_mark_delete(spark, sf):
    r = reports(spark, sf)
    gone = r.where("kind = 'purchase'").select((F.col("event_id") + 1).alias("event_id"))
    return r.where("kind <> 'purchase'").join(gone, "event_id", "left_anti").select("event_id")


@query("dml_mark_create", """, p AS (SELECT book_id, max(k) FILTER (WHERE kind = 'purchase') AS bookmark FROM reports GROUP BY 1), h AS (SELECT event_id AS id, book_id FROM reports WHERE kind = 'view')
SELECT r.event_id, CASE WHEN r.k > coalesce(p.bookmark, 0) + 1 THEN 'ahead' WHEN r.kind = 'click' AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = r.event_id - 150 AND h.book_id = r.book_id) THEN 'no highlight' ELSE 'created' END AS outcome FROM reports r JOIN p ON p.book_id = r.book_id""")
def dml_mark_create(spark, sf):
    """Reports as new marks at atom k; a click hangs on the highlight 150 reports before, if it is of its book."""
    r = reports(spark, sf)
    bookmarks = r.groupBy("book_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "purchase", F.col("k"))), F.lit(0)).alias("bookmark"))
    marks = r.select(F.col("event_id").alias("mark_id"), "book_id", F.col("k").alias("anchor"), F.when(F.col("kind") == "click", F.col("event_id") - 150).alias("linked_id"))
    highlights = r.where("kind = 'view'").select(F.col("event_id").alias("mark_id"), "book_id", F.lit(None).cast("timestamp").alias("deleted_at"))
    return L.new_marks(marks, bookmarks, highlights).withColumnRenamed("mark_id", "event_id")


ADMIT = """, held AS (SELECT o_custkey AS owner_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS books, coalesce(CAST(sum(q) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT), 0) AS bytes, count(*) FILTER (WHERE o_orderstatus = 'P') AS jobs
 FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey AS request_id, CASE WHEN o_totalprice > 400000 THEN 'upload_size_exceeded' WHEN books >= 4 + o_custkey % 9 THEN 'book_quota_exceeded' WHEN bytes + CAST(o_totalprice / 1000 AS BIGINT) > 900 THEN 'library_storage_exceeded' WHEN jobs >= 1 + o_custkey % 3 THEN 'active_job_limit_exceeded' ELSE 'admitted' END AS code
FROM orders JOIN held ON owner_id = o_custkey"""


def library(spark, sf):
    """Orders as books and jobs, their lines as source bytes, customers as owners with limits."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    deleted = F.when(F.col("o_orderstatus") == "F", F.lit("2024-01-01").cast("timestamp")).alias("deleted_at")
    books = o.select(F.col("o_custkey").alias("owner_id"), "o_orderkey", deleted)
    size = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("byte_size"))
    jobs = o.select(F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("state"))
    key = F.col("c_custkey")
    owners = spark.read.parquet(f"{sf}/customer.parquet").select(
        key.alias("owner_id"), F.lit(400).alias("max_upload"), F.lit(900).alias("max_library"), (4 + key % 9).alias("max_books"), (1 + key % 3).alias("max_jobs")
    )
    return books, books.join(size, "o_orderkey"), jobs, owners


@query("dml_admission", ADMIT.replace("o_totalprice > 400000", "CAST(o_totalprice / 1000 AS BIGINT) > 400"))
def dml_admission(spark, sf):
    """Orders as uploads, against the books, bytes and active jobs that their owners hold."""
    books, sources, jobs, owners = library(spark, sf)
    size = F.round(F.col("o_totalprice") / 1000).cast("long").alias("byte_size")
    requests = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("owner_id"), size)
    return J.admission(requests, owners, books, sources, jobs)


# Reports as jobs: the lease runs k - 50 hours from the report, and is judged at one moment.
JOBS = """, j AS (SELECT event_id AS job_id, CASE WHEN kind = 'view' THEN 'running' WHEN kind = 'click' THEN 'leased' ELSE 'pending' END AS state, event_id % 5 AS token, k % 5 AS attempt_count, 3 AS max_attempts, usd > 80 AS cancel_requested,
 ts + to_hours(CAST(k - 50 AS INT)) > TIMESTAMP '2024-01-15 00:00:00' AS held FROM reports) """
NOW = "2024-01-15 00:00:00"


def jobs(spark, sf):
    state = F.when(F.col("kind") == "view", "running").when(F.col("kind") == "click", "leased").otherwise("pending")
    until = F.timestamp_add("HOUR", (F.col("k") - 50).cast("int"), F.col("ts").cast("timestamp"))
    return reports(spark, sf).select(
        F.col("event_id").alias("job_id"), state.alias("state"), (F.col("event_id") % 5).alias("token"), (F.col("k") % 5).alias("attempt_count"),
        F.lit(3).alias("max_attempts"), (F.col("usd") > 80).alias("cancel_requested"), until.alias("lease_until"),
    )


@query("dml_job_fail", JOBS + """SELECT job_id, CASE WHEN state = 'pending' OR token = 4 OR attempt_count = 4 OR NOT held THEN 'lost' WHEN cancel_requested THEN 'cancelled' WHEN job_id % 2 = 0 AND attempt_count < 3 THEN 'pending' ELSE 'failed' END AS state FROM j""")
def dml_job_fail(spark, sf):
    """Failed attempts: a claim with an old token or attempt, or past its lease, has lost its job."""
    j = jobs(spark, sf)
    token = F.when(F.col("token") == 4, -1).otherwise(F.col("token"))
    attempt = F.when(F.col("attempt_count") == 4, 3).otherwise(F.col("attempt_count"))
    claims = j.select("job_id", token.alias("claim_token"), attempt.alias("claim_attempt"), (F.col("job_id") % 2 == 0).alias("retryable"), F.lit(30).alias("retry_seconds"))
    return J.fail(claims, j, F.lit(NOW).cast("timestamp")).select("job_id", "state")


@query("st_lease", JOBS + "SELECT job_id, CASE WHEN cancel_requested THEN 'cancelled' WHEN attempt_count < max_attempts THEN 'pending' ELSE 'failed' END AS state FROM j WHERE state <> 'pending' AND NOT held")
def st_lease(spark, sf):
    """Leases that have run out."""
    return J.expire(jobs(spark, sf), F.lit(NOW).cast("timestamp"))


@query("job_commit", JOBS + """SELECT job_id, CASE WHEN state = 'pending' OR token = 4 OR NOT held THEN 'lost' WHEN job_id % 3 = 0 THEN 'no-op' WHEN job_id % 3 = 1 AND job_id % 7 = 0 THEN 'changed' ELSE 'append' END AS outcome FROM j""")
def job_commit(spark, sf):
    """A chapter's commit by its lease holder only; the same content again is nothing, other content is an error."""
    j = jobs(spark, sf).withColumn("claim_token", F.when(F.col("token") == 4, -1).otherwise(F.col("token"))).withColumn("claim_attempt", F.col("attempt_count"))
    key = F.col("job_id").cast("string")
    done = j.where("job_id % 3 = 0").select(key.alias("chapter_key"), F.lit("h").alias("content_hash"))
    other = j.where("job_id % 3 = 1 and job_id % 7 = 0").select(key.alias("chapter_key"), F.lit("other").alias("content_hash"))
    return J.commits(j.withColumn("chapter_key", key).withColumn("content_hash", F.lit("h")), done.unionByName(other), F.lit(NOW).cast("timestamp"))


@query("dml_limits_update", """, u AS (SELECT book_id AS owner_id, CASE k % 10 WHEN 0 THEN 'colour' ELSE CASE k % 2 WHEN 1 THEN 'max_books' ELSE 'max_active_jobs' END END AS field, k AS value, ts, event_id FROM reports WHERE k % 10 <> 0 OR k > 80),
g AS (SELECT owner_id, bool_or(field = 'colour') AS bad, (list(value ORDER BY ts DESC, event_id DESC) FILTER (WHERE field = 'max_books'))[1] AS b, (list(value ORDER BY ts DESC, event_id DESC) FILTER (WHERE field = 'max_active_jobs'))[1] AS j FROM u GROUP BY 1)
SELECT coalesce(c_custkey, owner_id) AS owner_id, CASE WHEN c_custkey IS NOT NULL THEN CASE WHEN NOT coalesce(bad, true) THEN coalesce(b, 10) ELSE 10 END END AS max_books, CASE WHEN c_custkey IS NOT NULL THEN CASE WHEN NOT coalesce(bad, true) THEN coalesce(j, 20) ELSE 20 END END AS max_active_jobs,
 CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN bad IS NULL THEN 'unchanged' WHEN bad THEN 'refused' ELSE 'updated' END AS outcome FROM customer FULL JOIN g ON owner_id = c_custkey""")
def dml_limits_update(spark, sf):
    """Reports as changes of their user's limits; one of a field that may not be changed refuses them all."""
    limits = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("owner_id"), F.lit(10).cast("long").alias("max_books"), F.lit(20).cast("long").alias("max_active_jobs"))
    field = F.when(F.col("k") % 10 == 0, "colour").when(F.col("k") % 2 == 1, "max_books").otherwise("max_active_jobs")
    sent = reports(spark, sf).where("k % 10 <> 0 or k > 80")
    return L.updated_limits(limits, sent.select(F.col("book_id").alias("owner_id"), field.alias("field"), F.col("k").alias("value"), F.struct("ts", "event_id").alias("at")))


@query("dml_audit_purge", "SELECT event_id FROM reports WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def dml_audit_purge(spark, sf):
    return reports(spark, sf).where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("rel_safe_swap", """, v AS (SELECT book_id, (list(kind ORDER BY ts, event_id))[1] AS a1, (list(kind ORDER BY ts DESC, event_id DESC))[1] AS a2, (list(k % 4 ORDER BY ts, event_id))[1] AS b1, (list(k % 4 ORDER BY ts DESC, event_id DESC))[1] AS b2, (list(k % 2 ORDER BY ts, event_id))[1] AS c1, (list(k % 2 ORDER BY ts DESC, event_id DESC))[1] AS c2 FROM reports GROUP BY 1)
SELECT book_id, concat_ws(',', CASE WHEN a1 <> a2 THEN 'embeddings' END, CASE WHEN b1 <> b2 THEN 'extraction' END, CASE WHEN c1 <> c2 THEN 'recap' END) AS migrations FROM v""")
def rel_safe_swap(spark, sf):
    """A book's pinned identities (its first report's) against the current ones (its last one's)."""
    of = lambda pick: pick(F.struct("kind", F.col("k") % 4, F.col("k") % 2), F.struct("ts", "event_id")).cast("struct<embeddings:string,extraction:long,recap:long>")
    rows = reports(spark, sf).groupBy("book_id").agg(of(F.min_by).alias("pinned"), of(F.max_by).alias("current"))
    return rows.select("book_id", F.array_join(L.migrations("pinned", "current", ("embeddings", "extraction", "recap")), ",").alias("migrations"))


@query("tree_toc_label", ", t AS (SELECT doc_id, source || '/' || lang AS path FROM documents) SELECT path, min(doc_id) AS first_atom FROM t GROUP BY 1")
def tree_toc_label(spark, sf):
    """The first atom below each node of a flattened tree."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    return d.groupBy("path").agg(F.min("doc_id").alias("first_atom"))


@query("tree_toc_lookup", ", t AS (SELECT doc_id, source || '/' || lang AS path FROM documents) SELECT doc_id, path, min(doc_id) OVER (PARTITION BY path) AS first_atom, doc_id = min(doc_id) OVER (PARTITION BY path) AS opens FROM t")
def tree_toc_lookup(spark, sf):
    """Every atom's node of the flattened tree, and whether it is the one that opens it."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    first = d.groupBy("path").agg(F.min("doc_id").alias("first_atom"))
    return d.join(first, "path").select("doc_id", "path", "first_atom", (F.col("doc_id") == F.col("first_atom")).alias("opens"))


@query("snk_retention", ", n AS (SELECT event_id, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, event_id DESC) AS n, max(ts) OVER (PARTITION BY book_id) AS newest FROM reports) SELECT event_id FROM n WHERE n > 5 AND newest <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 12 HOUR")
def snk_retention(spark, sf):
    """Reports as archives: what a keep-the-newest-five policy removes of the books that are due."""
    rows = reports(spark, sf).select("book_id", F.col("event_id").alias("archive_id"), F.col("ts").cast("timestamp").alias("at"))
    return A.surplus(rows, 5, F.lit("2024-01-30 12:00:00").cast("timestamp"), 12).select(F.col("archive_id").alias("event_id"))


def _profile_sql() -> str:
    n = lambda p, c="coalesce(text, '')": f"len(regexp_extract_all({c}, '{p}'))".replace("A-Z' -", "A-Z'' -")
    titles = ", ".join(f"sum(CASE WHEN regexp_matches(coalesce(title, ''), '{p}') THEN 1 ELSE 0 END) AS t_{k}" for k, p in P.TITLES.items())
    extra = {"drama": " + least(0.2, cues / (n * 10.0))", "poetry": " + CASE WHEN shorts * 4 >= n * 3 THEN 0.1 ELSE 0 END", "reference": " + CASE WHEN shorts * 2 >= n THEN 0.05 ELSE 0 END"}
    scores = [f"SELECT book_id, n, '{k}' AS k, least(CAST({c} AS DOUBLE), {b} + {w} * (CAST(t_{k} AS DOUBLE) / n){extra.get(k, '')}) AS s FROM g" for k, (b, w, c) in P.SCORES.items()]
    novel = "CASE WHEN longs * 10 >= n * 6 AND verbs >= n * 2 THEN 0.82 + least(0.12, verbs / (n * 100.0)) WHEN t_chapter * 4 >= n * 3 AND verbs >= n * 2 THEN 0.76 ELSE 0 END"
    scores.append(f"SELECT book_id, n, 'novel', CAST(CASE WHEN t_anthology * 4 >= n * 3 THEN least({novel}, 0.5) ELSE {novel} END AS DOUBLE) FROM g")
    return (
        f", e AS (SELECT book_id, title, {n(r'\\S+')} AS words, {n(P.VERBS)} AS verbs, {n(P.SPEAKER)} + {n(P.STAGE)} AS cues FROM chapters), "
        f"g AS (SELECT book_id, count(*) AS n, count(*) FILTER (WHERE words <= 300) AS shorts, count(*) FILTER (WHERE words >= 500) AS longs, CAST(sum(verbs) AS BIGINT) AS verbs, CAST(sum(cues) AS BIGINT) AS cues, {titles} FROM e GROUP BY 1), "
        f"c AS ({' UNION ALL '.join(scores)}), o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY s DESC, k) AS r, lead(s) OVER (PARTITION BY book_id ORDER BY s DESC, k) AS second FROM c) "
        "SELECT book_id, n AS sections, CASE WHEN s < 0.65 OR s - second < 0.15 THEN 'unknown' ELSE k END AS book_type FROM o WHERE r = 1"
    )


@query("agg_book_profile", _profile_sql())
def agg_book_profile(spark, sf):
    """The type of every book, from all its chapters."""
    return P.book_types(bind(spark, sf, "chapters")).select("book_id", "sections", "book_type")
