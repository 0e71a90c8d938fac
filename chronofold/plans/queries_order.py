"""Windows, positions, state over time and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.functions import text as X
from chronofold.operators import ordering as O
from chronofold.operators.vectors import index_changes
from chronofold.operators.view import bookmark_literal
from chronofold.plans.queries_views import BOOK, VIS, at, book, receipted
from chronofold.plans.registry import query
from chronofold.plans.standins import bind

BOUNDS = ", b AS (SELECT *, CAST(sum(char_len) OVER (PARTITION BY book_id ORDER BY revealed_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM chapters) "


def bounded(spark, sf):
    return O.bounds(bind(spark, sf, "chapters"), F.col("char_len"))


@query("win_bounds", BOUNDS + "SELECT chapter_key, e - char_len AS start_at, e AS end_at FROM b")
def win_bounds(spark, sf):
    return bounded(spark, sf).select("chapter_key", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("win_char_ranges", """SELECT chapter_key, CAST(sum(greatest(1, char_len % 7)) OVER (PARTITION BY book_id ORDER BY revealed_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at FROM chapters""")
def win_char_ranges(spark, sf):
    rows = O.bounds(bind(spark, sf, "chapters"), F.greatest(F.lit(1), F.col("char_len") % 7))
    return rows.select("chapter_key", F.col("end").alias("end_at"))


@query("win_bookmark", BOUNDS + "SELECT book_id, count(*) FILTER (WHERE e <= 20000) AS bookmark FROM b GROUP BY 1")
def win_bookmark(spark, sf):
    return O.completed(bounded(spark, sf), F.lit(20_000))


@query("win_high_water", "SELECT event_id, max(k) OVER (PARTITION BY book_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high FROM reports")
def win_high_water(spark, sf):
    w = Window.partitionBy("book_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return bind(spark, sf, "reports").select("event_id", F.max("k").over(w).alias("high"))


@query("win_current_chapter", BOUNDS + """, p AS (SELECT book_id, 100 * count(*) AS pos, count(*) AS n FROM chapters GROUP BY 1)
SELECT p.book_id, coalesce(CAST(b.revealed_at AS BIGINT), n + 1) AS chapter FROM p LEFT JOIN b ON b.book_id = p.book_id AND b.e - b.char_len <= pos AND pos < b.e""")
def win_current_chapter(spark, sf):
    b = bounded(spark, sf)
    here = F.col("pos").between(F.col("start"), F.col("end") - 1)
    p = b.groupBy("book_id").agg((F.count(F.lit(1)) * 100).alias("pos"), F.count(F.lit(1)).alias("n"))
    rows = b.join(p, "book_id")
    return rows.groupBy("book_id").agg(F.coalesce(F.max(F.when(here, F.col("revealed_at").cast("long"))), F.first("n") + 1).alias("chapter"))


@query("win_progress", BOUNDS + "SELECT chapter_key, CAST(CASE WHEN 30000 >= e THEN 10000 WHEN 30000 <= e - char_len THEN 0 ELSE ((30000 - (e - char_len)) * 10000) // char_len END AS BIGINT) AS per_10000 FROM b")
def win_progress(spark, sf):
    done = F.when(F.lit(30_000) >= F.col("end"), F.lit(10_000)).when(F.lit(30_000) <= F.col("start"), F.lit(0))
    part = F.expr("(30000 - start) * 10000 div char_len")
    return bounded(spark, sf).select("chapter_key", done.otherwise(part).cast("long").alias("per_10000"))


@query("agg_frontier", """, j AS (SELECT c.book_id, c.revealed_at, r.chapter_key IS NOT DISTINCT FROM c.chapter_key AND r.content_hash IS NOT DISTINCT FROM c.content_hash AS ok
 FROM chapters c LEFT JOIN receipts r ON r.book_id = c.book_id AND r.ordinal = c.revealed_at),
f AS (SELECT book_id, min(revealed_at) FILTER (WHERE NOT ok) AS gap, max(revealed_at) AS last FROM j GROUP BY 1)
SELECT book_id, coalesce(gap - 1, last) AS frontier FROM f""")
def agg_frontier(spark, sf):
    return O.frontier(bind(spark, sf, "chapters"), bind(spark, sf, "receipts"))


@query("win_sample_rows", """, r AS (SELECT chapter_key, book_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY book_id) AS c FROM chapters WINDOW w AS (PARTITION BY book_id ORDER BY revealed_at)),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n) AS m FROM r WHERE n = 1 OR n = c OR n % CAST(ceil(c / 4.0) AS INT) = 0)
SELECT chapter_key, n FROM k WHERE m <= 6""")
def win_sample_rows(spark, sf):
    w = Window.partitionBy("book_id").orderBy("revealed_at")
    r = bind(spark, sf, "chapters").withColumn("n", F.row_number().over(w).cast("long")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("book_id")))
    kept = r.where((F.col("n") == 1) | (F.col("n") == F.col("c")) | (F.col("n") % F.ceil(F.col("c") / 4) == 0))
    return kept.withColumn("m", F.row_number().over(Window.partitionBy("book_id").orderBy("n"))).where("m <= 6").select("chapter_key", "n")


@query("win_excerpts", "SELECT doc_id, CASE WHEN length(text) <= 7500 THEN text ELSE substring(text, 1, 2500) || substring(text, length(text) // 2 - 1249, 2500) || right(text, 2500) END AS excerpt FROM documents")
def win_excerpts(spark, sf):
    """A text whole, or its beginning, middle and end of 2,500 characters each."""
    middle = F.expr("substring(text, cast(length(text) div 2 as int) - 1249, 2500)")
    cut = F.concat(F.left("text", F.lit(2_500)), middle, F.right("text", F.lit(2_500)))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.when(F.length("text") <= 7_500, F.col("text")).otherwise(cut).alias("excerpt"))


@query("win_passages", r""", n AS (SELECT doc_id, trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, t, CAST(ceil(length(t) / 1500.0) AS INT) AS k FROM n WHERE t <> ''),
i AS (SELECT doc_id, t, k, unnest(CASE WHEN k <= 6 THEN range(0, k) ELSE list_distinct([CAST(round_even(x * (k - 1) / 5.0, 0) AS BIGINT) FOR x IN range(0, 6)]) END) AS i FROM c)
SELECT doc_id, i AS at, substring(t, CAST(i * 1500 + 1 AS INT), 1500) AS passage FROM i""")
def win_passages(spark, sf):
    """At most six evenly spaced passages of 1,500 characters of the white-space-normalised text."""
    t = F.trim(F.regexp_replace("text", r"[ \n\t\r]+", " "))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", t.alias("t")).where("t <> ''")
    k = F.ceil(F.length("t") / 1500)
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: F.bround(x * (k - 1) / 5.0, 0).cast("long")))
    rows = rows.withColumn("i", F.explode(F.when(k <= 6, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(even)))
    return rows.select("doc_id", F.col("i").alias("at"), F.expr("substring(t, cast(i * 1500 + 1 as int), 1500)").alias("passage"))


FIRST = r""", w AS (SELECT DISTINCT revealed_at, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS tok FROM chapters WHERE book_id = 'src0'),
f AS (SELECT tok, min(revealed_at) AS first_at FROM w GROUP BY 1)
"""


def first_seen(spark, sf):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))).alias("tok")
    rows = bind(spark, sf, "chapters").where(F.col("book_id") == BOOK).select("revealed_at", words)
    return rows.groupBy("tok").agg(F.min("revealed_at").alias("first_at"))


@query("win_floor_cum", FIRST + "SELECT first_at, count(*) AS new_tokens, CAST(sum(count(*)) OVER (ORDER BY first_at) AS BIGINT) AS known FROM f GROUP BY 1")
def win_floor_cum(spark, sf):
    per = first_seen(spark, sf).groupBy("first_at").agg(F.count(F.lit(1)).alias("new_tokens"))
    return per.withColumn("known", F.sum("new_tokens").over(Window.orderBy("first_at")))  # one row per chapter


@query("agg_grounding_rate", FIRST + """, s AS (SELECT chapter_key, revealed_at, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{M}\\p{N}]+')) AS tok FROM chapters WHERE book_id = 'src0')
SELECT chapter_key, count(*) AS n, count(*) FILTER (WHERE first_at <= s.revealed_at) AS grounded FROM s LEFT JOIN f ON f.tok = s.tok GROUP BY 1""".replace("\\\\", "\\"))
def agg_grounding_rate(spark, sf):
    tok = F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("tok")
    s = bind(spark, sf, "chapters").where(F.col("book_id") == BOOK).select("chapter_key", "revealed_at", tok)
    rows = s.join(first_seen(spark, sf), "tok", "left")
    return rows.groupBy("chapter_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_at") <= F.col("revealed_at")).alias("grounded"))


@query("win_event_order", "SELECT event_id, row_number() OVER (PARTITION BY revealed_at ORDER BY event_id) AS order_idx FROM events_")
def win_event_order(spark, sf):
    """Events numbered within their chapters by range, so that no chapter is one task."""
    return O.numbered(bind(spark, sf, "events_").select("revealed_at", "event_id"), "revealed_at", "event_id").select("event_id", F.col("n").alias("order_idx"))


@query("win_body_window", """, m AS (SELECT *, min(CASE WHEN char_len >= 1000 THEN revealed_at END) OVER (PARTITION BY book_id) AS lo, max(CASE WHEN char_len >= 1000 THEN revealed_at END) OVER (PARTITION BY book_id) AS hi FROM chapters)
SELECT chapter_key, CASE WHEN lo IS NULL OR revealed_at < lo THEN 'front' WHEN revealed_at > hi THEN 'back' ELSE 'body' END AS part FROM m""")
def win_body_window(spark, sf):
    body = F.when(F.col("char_len") >= 1000, F.col("revealed_at"))
    w = Window.partitionBy("book_id")
    rows = bind(spark, sf, "chapters").withColumn("lo", F.min(body).over(w)).withColumn("hi", F.max(body).over(w))
    part = F.when(F.col("lo").isNull() | (F.col("revealed_at") < F.col("lo")), "front").when(F.col("revealed_at") > F.col("hi"), "back").otherwise("body")
    return rows.select("chapter_key", part.alias("part"))


@query("win_dedupe_first", "SELECT min(page_id) AS page_id, regexp_replace(url, '[?#].*$', '') AS href FROM pages GROUP BY 2")
def win_dedupe_first(spark, sf):
    href = F.regexp_replace("url", "[?#].*$", "")
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", href.alias("href"))
    return O.latest(rows, ["href"], F.asc("page_id"))


@query("win_storythread_label", VIS + """SELECT least(src_entity, dst_entity) AS a, greatest(src_entity, dst_entity) AS b, lower(label) AS label_key, min(revealed_at) AS first_at FROM vr GROUP BY 1, 2, 3""")
def win_storythread_label(spark, sf):
    rows = at(spark, sf).relationships()
    return rows.groupBy(F.least("src_entity", "dst_entity").alias("a"), F.greatest("src_entity", "dst_entity").alias("b"), F.lower("label").alias("label_key")).agg(F.min("revealed_at").alias("first_at"))


@query("agg_register", VIS + r""", k AS (SELECT src_entity, dst_entity, rel_type, revealed_at, edge_id, trim(regexp_replace(lower(rel_type), '[^a-z0-9]+', ' ', 'g')) AS label_key FROM vr)
SELECT src_entity, dst_entity, label_key, min(revealed_at) AS first_at, (list(rel_type ORDER BY revealed_at, edge_id))[1] AS text FROM k GROUP BY 1, 2, 3""")
def agg_register(spark, sf):
    """Statements of one person about another: directed, one per label, with its first wording."""
    rows = at(spark, sf).relationships().withColumn("label_key", X.label_key(F.col("rel_type")))
    first = F.min_by("rel_type", F.struct("revealed_at", "edge_id"))
    return rows.groupBy("src_entity", "dst_entity", "label_key").agg(F.min("revealed_at").alias("first_at"), first.alias("text"))


@query("agg_connections", VIS + """, x AS (SELECT dst_entity AS other, rel_type, min(revealed_at) AS m FROM vr WHERE src_entity IN (SELECT entity_id FROM ve WHERE type = 'character') GROUP BY 1, 2)
SELECT other, count(*) AS statements, min(m) AS first_at, max(m) AS last_at FROM x GROUP BY 1""")
def agg_connections(spark, sf):
    rows = at(spark, sf).relationships().groupBy(F.col("dst_entity").alias("other"), "rel_type").agg(F.min("revealed_at").alias("m"))
    return rows.groupBy("other").agg(F.count(F.lit(1)).alias("statements"), F.min("m").alias("first_at"), F.max("m").alias("last_at"))


@query("agg_degree", VIS + """, d AS (SELECT src_entity AS e, dst_entity AS o FROM vr UNION SELECT dst_entity, src_entity FROM vr),
c AS (SELECT e, count(DISTINCT o) AS degree FROM d GROUP BY 1) SELECT c.e AS entity_id, degree FROM c JOIN ve ON ve.entity_id = c.e ORDER BY degree DESC, revealed_at, c.e LIMIT 1""")
def agg_degree(spark, sf):
    v = at(spark, sf)
    r = v.relationships()
    both = r.select(F.col("src_entity").alias("entity_id"), F.col("dst_entity").alias("o")).unionByName(r.select(F.col("dst_entity").alias("entity_id"), F.col("src_entity").alias("o")))
    degree = both.groupBy("entity_id").agg(F.count_distinct("o").alias("degree"))
    return degree.join(v.entities(), "entity_id").orderBy(F.desc("degree"), "revealed_at", "entity_id").limit(1).select("entity_id", "degree")


@query("date_gap", "SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY book_id ORDER BY ts, event_id)) > 14400, false) AS welcome_back FROM reports")
def date_gap(spark, sf):
    before = F.lag("ts").over(Window.partitionBy("book_id").orderBy("ts", "event_id"))
    gap = F.timestamp_diff("MICROSECOND", before, F.col("ts")) > 4 * 3600 * 1_000_000
    return bind(spark, sf, "reports").select("event_id", F.coalesce(gap, F.lit(False)).alias("welcome_back"))


@query("date_ttl", "SELECT event_id FROM reports WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 60 SECOND AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def date_ttl(spark, sf):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    ts = F.col("ts")
    return bind(spark, sf, "reports").where((ts > now - F.expr("interval 60 seconds")) & (ts <= F.lit("2024-01-20 12:00:00").cast("timestamp"))).select("event_id")


@query("st_high_water", "SELECT book_id, max(k) AS bookmark FROM reports GROUP BY 1")
def st_high_water(spark, sf):
    """The batch twin of ``chronofold.streaming.position.high_water``."""
    return bind(spark, sf, "reports").groupBy("book_id").agg(F.max("k").alias("bookmark"))


@query("st_progress_max", "SELECT event_id, max(k) OVER (PARTITION BY book_id, kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress, k < max(k) OVER (PARTITION BY book_id, kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS behind FROM reports")
def st_progress_max(spark, sf):
    """Progress after each report of a job (a book and kind): it only rises, a report behind it changes nothing."""
    upto = F.max("k").over(Window.partitionBy("book_id", "kind").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return bind(spark, sf, "reports").select("event_id", upto.alias("progress"), (F.col("k") < upto).alias("behind"))


@query("st_reset_epoch", """, e AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM reports)
SELECT book_id, CAST(epoch AS BIGINT) AS epoch, coalesce(max(k) FILTER (WHERE kind <> 'purchase'), 0) AS bookmark FROM e GROUP BY 1, 2""")
def st_reset_epoch(spark, sf):
    w = Window.partitionBy("book_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    reset = F.col("kind") == "purchase"
    rows = bind(spark, sf, "reports").withColumn("epoch", F.sum(reset.cast("int")).over(w))
    return rows.groupBy("book_id", "epoch").agg(F.coalesce(F.max(F.when(~reset, F.col("k"))), F.lit(0)).alias("bookmark"))


@query("st_debounce", """, n AS (SELECT *, lead(ts) OVER (PARTITION BY book_id ORDER BY ts, event_id) AS nxt FROM reports)
SELECT event_id FROM n WHERE nxt IS NULL OR epoch(nxt) - epoch(ts) > 600""")
def st_debounce(spark, sf):
    return O.debounce(bind(spark, sf, "reports"), "book_id", "ts", 600, "event_id").select("event_id")


@query("st_outbox", """, u AS (SELECT *, row_number() OVER (PARTITION BY book_id, kind ORDER BY ts DESC, event_id DESC) AS n FROM reports),
o AS (SELECT event_id, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN kind = 'view' THEN 0 ELSE 1 END, ts, event_id) AS place FROM u WHERE n = 1 AND k % 10 NOT IN (4, 9))
SELECT event_id, place FROM o WHERE place <= 1000""")
def st_outbox(spark, sf):
    """Upsert by id, then positions first, refused ones dropped, at most 1,000 an owner (the queue's own bound)."""
    kept = O.latest(bind(spark, sf, "reports"), ["book_id", "kind"], F.desc("ts"), F.desc("event_id")).where(~(F.col("k") % 10).isin(4, 9))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.when(F.col("kind") == "view", 0).otherwise(1), "ts", "event_id"))
    return kept.select("event_id", place.alias("place")).where("place <= 1000")


@query("set_marks_union", "SELECT event_id, 'h' AS kind, usd AS amount, CAST(NULL AS BIGINT) AS k FROM reports WHERE kind = 'view' UNION ALL SELECT event_id, 'a', NULL, k FROM reports WHERE kind = 'click' UNION ALL SELECT event_id, 'b', NULL, NULL FROM reports WHERE kind = 'purchase'")
def set_marks_union(spark, sf):
    r = bind(spark, sf, "reports")
    h = r.where("kind = 'view'").select("event_id", F.lit("h").alias("kind"), F.col("usd").alias("amount"))
    a = r.where("kind = 'click'").select("event_id", F.lit("a").alias("kind"), "k")
    b = r.where("kind = 'purchase'").select("event_id", F.lit("b").alias("kind"))
    return h.unionByName(a, True).unionByName(b, True).orderBy("event_id")


@query("set_visible_future", FIRST + "SELECT tok, first_at <= 24 AS seen FROM f WHERE first_at <= 24 OR tok NOT IN ('a', 'the')")
def set_visible_future(spark, sf):
    f = first_seen(spark, sf)
    allowed = spark.createDataFrame([("a",), ("the",)], "tok string")
    future = f.where("first_at > 24").join(allowed, "tok", "left_anti").select("tok", F.lit(False).alias("seen"))
    return f.where("first_at <= 24").select("tok", F.lit(True).alias("seen")).unionByName(future)


@query("set_subset", r"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(substring(text, 1, 100)), '[a-z]+')), lambda x: NOT list_contains(regexp_extract_all(lower(substring(text, 101)), '[a-z]+'), x))) = 0 AS inside FROM documents")
def set_subset(spark, sf):
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    rest = F.expr("substring(text, 101)")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.size(F.array_except(w(F.substring("text", 1, 100)), w(rest))) == 0).alias("inside"))


@query("set_overlap", VIS + "SELECT surface, count(DISTINCT entity_id) AS bearers, min(entity_id) AS least FROM va GROUP BY 1 HAVING count(DISTINCT entity_id) > 1")
def set_overlap(spark, sf):
    """Names that several entities bear, with their number and the least of them, not all pairs of bearers."""
    a = at(spark, sf).aliases().select("surface", "entity_id").distinct()
    return a.groupBy("surface").agg(F.count(F.lit(1)).alias("bearers"), F.min("entity_id").alias("least")).where("bearers > 1")


@query("set_verify_equal", """, x AS (SELECT event_id, k FROM reports), y AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN k + 1 ELSE k END AS k FROM reports)
SELECT event_id, k, 'lost' AS what FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT event_id, k, 'new' FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)""")
def set_verify_equal(spark, sf):
    """Both directions of the multiset difference; equal snapshots give no row."""
    x = bind(spark, sf, "reports").select("event_id", "k")
    y = x.withColumn("k", F.when(F.col("event_id") % 50 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return x.exceptAll(y).withColumn("what", F.lit("lost")).unionByName(y.exceptAll(x).withColumn("what", F.lit("new")))


@query("idx_vec_sync", """, i AS (SELECT chunk_id, CASE WHEN chunk_id % 11 = 0 THEN vec[1] + 1 ELSE vec[1] END AS x, CASE WHEN chunk_id % 17 = 0 THEN 'model-9' ELSE model END AS model FROM chunks WHERE chunk_id % 7 <> 0),
c AS (SELECT chunk_id, vec[1] AS x, model FROM chunks WHERE retracted_at IS NULL)
SELECT coalesce(c.chunk_id, i.chunk_id) AS chunk_id, CASE WHEN i.chunk_id IS NULL THEN 'add' WHEN c.chunk_id IS NULL THEN 'remove' ELSE 'replace' END AS change FROM c FULL JOIN i ON i.chunk_id = c.chunk_id WHERE c.chunk_id IS NULL OR i.chunk_id IS NULL OR c.x <> i.x OR c.model <> i.model""")
def idx_vec_sync(spark, sf):
    """A derived vector index against the live chunks: some are missing, changed, of another space or retracted."""
    c = bind(spark, sf, "chunks")
    first = F.when(F.col("chunk_id") % 11 == 0, F.get("vec", F.lit(0)) + 1).otherwise(F.get("vec", F.lit(0)))
    vec = F.concat(F.array(first.cast("float")), F.slice("vec", 2, 10_000))
    index = c.where("chunk_id % 7 <> 0").select("chunk_id", vec.alias("vec"), F.when(F.col("chunk_id") % 17 == 0, "model-9").otherwise(F.col("model")).alias("model"))
    return index_changes(c.where("retracted_at is null").select("chunk_id", "vec", "model"), index)


@query("set_dedupe_marks", """, p AS (SELECT event_id % 400 AS mark_id, ts, event_id, kind, k, row_number() OVER (PARTITION BY event_id % 400 ORDER BY ts DESC, event_id DESC) AS n FROM reports)
SELECT mark_id, k FROM p WHERE n = 1 AND kind <> 'purchase'""")
def set_dedupe_marks(spark, sf):
    """Pending mutations folded by mark: the last one wins, a delete removes."""
    rows = bind(spark, sf, "reports").withColumn("mark_id", F.col("event_id") % 400)
    return O.latest(rows, ["mark_id"], F.desc("ts"), F.desc("event_id")).where("kind <> 'purchase'").select("mark_id", "k")


@query("gate_read_text", VIS + """SELECT c.chapter_key, CAST(coalesce(sum(length(c.text) + 1) OVER (ORDER BY c.revealed_at, c.chapter_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_, c.text FROM vc c""")
def gate_read_text(spark, sf):
    """What has been read of a book: its chapters in order, whole, each with the place where it begins in the joined text."""
    rows = book(spark, sf).chapters().select("chapter_key", "revealed_at", "text", F.length("text").alias("n"))
    place = F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("revealed_at", "chapter_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.select("chapter_key", "revealed_at", "n").select("chapter_key", place.cast("long").alias("at_"))  # lengths only, of one book
    return rows.join(starts, "chapter_key").select("chapter_key", "at_", "text")


@query("agg_atom_hash", "SELECT book_id, substring(sha256(string_agg(CAST(revealed_at AS VARCHAR) || ':' || chapter_key || ':' || CAST(char_len AS VARCHAR), '|' ORDER BY revealed_at)), 1, 16) AS hash FROM chapters GROUP BY 1")
def agg_atom_hash(spark, sf):
    part = F.concat_ws(":", F.col("revealed_at").cast("string"), "chapter_key", F.col("char_len").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("revealed_at", part.alias("p")))), lambda x: x["p"])
    return bind(spark, sf, "chapters").groupBy("book_id").agg(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 16).alias("hash"))


@query("agg_snapshot", VIS + """, parts AS (SELECT 'entities:' || entity_id || ':None:' AS p FROM ve WHERE type = 'faction'
 UNION ALL SELECT 'edges:' || CAST(edge_id AS VARCHAR) || ':' || coalesce(CAST(invalid_at AS VARCHAR), 'None') || ':' FROM vr
 UNION ALL SELECT 'events:' || CAST(event_id AS VARCHAR) || ':None:' || CAST(order_idx AS VARCHAR) FROM vt
 UNION ALL SELECT 'event_participants:' || CAST(p.event_id AS VARCHAR) || '-' || p.entity_id FROM vp p WHERE p.event_id IN (SELECT event_id FROM vt) AND p.entity_id IN (SELECT entity_id FROM ve))
SELECT count(*) AS facts, CAST(sum(CAST(('0x' || substring(sha256(p), 1, 15)) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || substring(sha256(p), 16, 15)) AS BIGINT)) AS VARCHAR) AS snapshot FROM parts""")
def agg_snapshot(spark, sf):
    """A digest of all that is visible: sums over the facts' hashes, so equal facts give equal digests in any order and no task holds them all."""
    v = at(spark, sf)
    s = lambda c: F.col(c).cast("string")
    parts = v.entities("faction").select(F.concat(F.lit("entities:"), "entity_id", F.lit(":None:")).alias("p"))
    parts = parts.unionByName(v.relationships().select(F.concat(F.lit("edges:"), s("edge_id"), F.lit(":"), F.coalesce(s("invalid_at"), F.lit("None")), F.lit(":")).alias("p")))
    parts = parts.unionByName(v.timeline().select(F.concat(F.lit("events:"), s("event_id"), F.lit(":None:"), s("order_idx")).alias("p")))
    parts = parts.unionByName(v.participants().select(F.concat(F.lit("event_participants:"), s("event_id"), F.lit("-"), "entity_id").alias("p")))
    return O.multiset_digest(parts, "p").select(F.col("rows").alias("facts"), F.col("digest").alias("snapshot"))


@query("agg_merge_extractions", "SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> '') AS summary, count(*) AS parts FROM conversations GROUP BY 1")
def agg_merge_extractions(spark, sf):
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda x: x["t"]), lambda t: t != "")
    out = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.array_join(parts, " ").alias("summary"), F.count(F.lit(1)).alias("parts"))
    return out.withColumn("summary", F.when(F.col("summary") != "", F.col("summary")))


@query("agg_file_counts", "SELECT chapter_key, count(*) OVER (PARTITION BY book_id, content_language) AS anchors, greatest(1, char_len // count(*) OVER (PARTITION BY book_id, content_language)) AS share FROM chapters")
def agg_file_counts(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("book_id", "content_language"))
    return bind(spark, sf, "chapters").withColumn("anchors", n).select("chapter_key", "anchors", F.greatest(F.lit(1), F.expr("char_len div anchors")).alias("share"))


@query("agg_archive_check", """, x AS (SELECT revealed_at, invalid_at, retracted_at FROM entities), y AS (SELECT CASE WHEN entity_id = 's1' THEN 999 ELSE revealed_at END AS revealed_at, invalid_at, retracted_at FROM entities WHERE entity_id <> 'c1')
SELECT (SELECT count(*) FROM x) AS planned, (SELECT count(*) FROM y) AS found, (SELECT count(*) FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)) AS lost, (SELECT count(*) FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)) AS extra""")
def agg_archive_check(spark, sf):
    """A plan against what was found: one entity missing, one with another time."""
    x = bind(spark, sf, "entities")
    y = x.where("entity_id <> 'c1'").withColumn("revealed_at", F.when(F.col("entity_id") == "s1", 999).otherwise(F.col("revealed_at")))
    return O.multiset_difference(x, y, ["revealed_at", "invalid_at", "retracted_at"])


@query("agg_receipts", VIS + ", rc AS (SELECT c.chapter_key, c.book_id, c.revealed_at FROM chapters c JOIN receipts r ON r.book_id = c.book_id AND r.chapter_key = c.chapter_key AND r.ordinal = c.revealed_at AND r.content_hash = c.content_hash WHERE c.retracted_at IS NULL) SELECT book_id, count(*) AS receipts FROM rc WHERE revealed_at <= 24 GROUP BY 1")
def agg_receipts(spark, sf):
    return receipted(spark, sf).where("revealed_at <= 24").groupBy("book_id").agg(F.count(F.lit(1)).alias("receipts"))


@query("agg_max_chapter", "SELECT book_id, coalesce(max(revealed_at) FILTER (WHERE retracted_at IS NULL), 0) AS last FROM chapters GROUP BY 1")
def agg_max_chapter(spark, sf):
    live = F.when(F.col("retracted_at").isNull(), F.col("revealed_at"))
    return bind(spark, sf, "chapters").groupBy("book_id").agg(F.coalesce(F.max(live), F.lit(0)).alias("last"))


@query("agg_resolution_quality", """, o AS (SELECT d.doc_id, coalesce(d.lang, '') AS gold, CASE WHEN length(d.text) % 3 = 0 THEN 'x' || CAST(length(d.text) % 5 AS VARCHAR) ELSE d.lang || CAST(d.doc_id % 2 AS VARCHAR) END AS pred FROM documents d),
q AS (SELECT count(*) FILTER (WHERE a.gold = b.gold AND a.pred = b.pred) AS tp, count(*) FILTER (WHERE a.gold <> b.gold AND a.pred = b.pred) AS fp, count(*) FILTER (WHERE a.gold = b.gold AND a.pred <> b.pred) AS fn
FROM o a JOIN o b ON a.doc_id < b.doc_id AND (a.gold = b.gold OR a.pred = b.pred)), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS c FROM q)
SELECT tp, fp, fn, CAST(round(1000000 * p) AS BIGINT) AS precision, CAST(round(1000000 * c) AS BIGINT) AS recall, CAST(round(1000000 * 2 * p * c / (p + c)) AS BIGINT) AS f1,
 (SELECT count(*) FROM (SELECT pred FROM o GROUP BY 1 HAVING count(DISTINCT gold) > 1)) AS over_merged, (SELECT count(*) FROM (SELECT gold FROM o GROUP BY 1 HAVING count(DISTINCT pred) > 1)) AS fragmented, 2 * p * c / (p + c) >= 0.8 AS passed FROM r""")
def agg_resolution_quality(spark, sf):
    """Documents in clusters by guess and by language, scored by pairs from cluster sizes alone."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    guess = F.when(F.length("text") % 3 == 0, F.concat(F.lit("x"), (F.length("text") % 5).cast("string"))).otherwise(F.concat("lang", (F.col("doc_id") % 2).cast("string")))
    s = O.pair_quality(d.select(F.coalesce("lang", F.lit("")).alias("gold"), guess.alias("pred")), 0.8)
    micro = lambda c: F.round(1_000_000 * F.col(c)).cast("long").alias(c)
    return s.select("tp", "fp", "fn", micro("precision"), micro("recall"), micro("f1"), "over_merged", "fragmented", "passed")


# What clients send as a bookmark: a number, a string, a fraction, a truth value.
SENT = """CASE event_id % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN '"' || CAST(k AS VARCHAR) || '"' WHEN 2 THEN CAST(k AS VARCHAR) || '.0' WHEN 3 THEN 'true' END"""


@query("vis_guard", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN k END AS bookmark FROM reports")
def vis_guard(spark, sf):
    """What is no whole number is no bookmark."""
    raw = bind(spark, sf, "reports").withColumn("sent", F.expr(SENT.replace("VARCHAR", "STRING")))
    return raw.select("event_id", bookmark_literal(F.col("sent")).alias("bookmark"))


@query("math_normalize", "SELECT chunk_id, CAST(round(1000000 * CAST(vec[1] AS DOUBLE) / sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS BIGINT) AS micro FROM chunks")
def math_normalize(spark, sf):
    from chronofold.operators.vectors import norm

    c = bind(spark, sf, "chunks")
    return c.select("chunk_id", F.round(1_000_000 * F.get("vec", F.lit(0)).cast("double") / norm(F.col("vec"))).cast("long").alias("micro"))


@query("date_now", "SELECT event_id, ts > CAST(now() AS TIMESTAMP) AS ahead FROM reports")
def date_now(spark, sf):
    """Reports that claim a time yet to come."""
    return bind(spark, sf, "reports").select("event_id", (F.col("ts").cast("timestamp") > F.current_timestamp()).alias("ahead"))


@query("st_worker_loop", "SELECT book_id, max(k) AS target FROM reports WHERE kind <> 'error' GROUP BY 1")
def st_worker_loop(spark, sf):
    """The batch twin of ``streaming.position.ingest``: one target a book, which only rises."""
    return bind(spark, sf, "reports").where("kind <> 'error'").groupBy("book_id").agg(F.max("k").alias("target"))


@query("st_lru_ttl", """, r AS (SELECT book_id, kind, max(ts) AS used FROM reports GROUP BY 1, 2), m AS (SELECT *, max(used) OVER (PARTITION BY book_id) AS latest FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY used DESC, kind) AS n FROM m WHERE used > latest - INTERVAL 48 HOUR) SELECT book_id, kind FROM n WHERE n <= 3""")
def st_lru_ttl(spark, sf):
    """Results kept by key: of those used in the two days before a book's last use, the three used last."""
    used = bind(spark, sf, "reports").groupBy("book_id", "kind").agg(F.max("ts").alias("used"))
    return O.kept_results(used, "book_id", "used", "kind", most=3, hours=48).select("book_id", "kind")
