"""Visibility, closure joins and view aggregates over the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.operators import view as V
from chronofold.operators.view import effective_bookmark, chapters_with, roster_text
from chronofold.plans.registry import query
from chronofold.plans.standins import bind

BM = 24
BOOK = "src0"
LIVE = "revealed_at <= 24 AND retracted_at IS NULL"
VALID = LIVE + " AND (invalid_at IS NULL OR invalid_at > 24)"
VIS = f""", ve AS (SELECT * FROM entities WHERE {VALID}),
va AS (SELECT * FROM aliases WHERE {LIVE} AND entity_id IN (SELECT entity_id FROM ve)),
vr AS (SELECT * FROM edges WHERE {VALID} AND src_entity IN (SELECT entity_id FROM ve) AND dst_entity IN (SELECT entity_id FROM ve)),
vt AS (SELECT * FROM events_ WHERE {VALID}),
vp AS (SELECT * FROM participants WHERE revealed_at <= 24),
vc AS (SELECT * FROM chapters WHERE {LIVE} AND book_id = 'src0'),
vs AS (SELECT * FROM summaries WHERE {LIVE} AND book_id = 'src0')
"""


def memory(spark: SparkSession, sf: str) -> V.Memory:
    names = ("entities", "edges", "participants", "states", "aliases", "themes", "chapters", "summaries", "chunks")
    return V.Memory(events=bind(spark, sf, "events_"), **{n: bind(spark, sf, n) for n in names})


def at(spark: SparkSession, sf: str, bookmark: int = BM) -> V.BookmarkView:
    return memory(spark, sf).view(bookmark)


def book(spark: SparkSession, sf: str, bookmark: int = BM) -> V.BookmarkView:
    return memory(spark, sf).view(bookmark, BOOK)


@query("src_fact_scan", VIS + "SELECT entity_id, canonical_name, revealed_at FROM ve")
@query("vis_funnel", VIS + "SELECT entity_id, canonical_name, revealed_at FROM ve")
def vis_funnel(spark, sf):
    return at(spark, sf).rows("entities").select("entity_id", "canonical_name", "revealed_at")


@query("src_audit_scan", "SELECT count(*) AS n, CAST(sum(revealed_at) AS BIGINT) AS s, count(retracted_at) AS gone FROM edges")
def src_audit_scan(spark, sf):
    return memory(spark, sf).audit("edges").agg(F.count(F.lit(1)).alias("n"), F.sum("revealed_at").alias("s"), F.count("retracted_at").alias("gone"))


@query("vis_chapters", VIS + "SELECT chapter_key, revealed_at, title FROM vc")
def vis_chapters(spark, sf):
    return book(spark, sf).chapters().select("chapter_key", "revealed_at", "title").orderBy("revealed_at", "chapter_key")


@query("vis_entities_type", VIS + "SELECT entity_id, revealed_at FROM ve WHERE type = 'faction'")
def vis_entities_type(spark, sf):
    return at(spark, sf).entities("faction").select("entity_id", "revealed_at").orderBy("revealed_at", "entity_id")


@query("vis_timeline", VIS + "SELECT event_id, summary, revealed_at, order_idx FROM vt")
def vis_timeline(spark, sf):
    return at(spark, sf).timeline().select("event_id", "summary", "revealed_at", "order_idx").orderBy("revealed_at", "order_idx", "event_id")


@query("vis_themes", f"SELECT theme_id, name, revealed_at FROM themes WHERE {VALID}")
def vis_themes(spark, sf):
    return at(spark, sf).themes().select("theme_id", "name", "revealed_at").orderBy("revealed_at", "theme_id")


@query("vis_delta", VIS + "SELECT event_id, summary FROM vt WHERE revealed_at = 24")
def vis_delta(spark, sf):
    return at(spark, sf).timeline().where(F.col("revealed_at") == BM).select("event_id", "summary")


# Each report asks for its k (every fifth for nothing, every seventh for less than 0) of its user's book: the
# position is the user's greatest k, the durable frontier the number of kinds committed, x 20, the ingested one
# the number of the user's reports.
CLAMP = """, p AS (SELECT book_id, max(k) AS stored, count(DISTINCT kind) * 20 AS durable, count(*) AS ingested FROM reports GROUP BY 1),
q AS (SELECT r.event_id, p.*, CASE WHEN r.k % 5 = 0 THEN NULL WHEN r.k % 7 = 0 THEN -1 ELSE r.k END AS asked FROM reports r JOIN p ON p.book_id = r.book_id) """


def asked(spark, sf):
    r = bind(spark, sf, "reports")
    held = r.groupBy("book_id").agg(F.max("k").alias("stored"), (F.count_distinct("kind") * 20).alias("durable"), F.count(F.lit(1)).alias("ingested"))
    want = F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 7 == 0, -1).otherwise(F.col("k"))
    return r.select("event_id", "book_id", want.alias("asked")).join(held, "book_id")


@query("vis_clamp", CLAMP + "SELECT event_id, CASE WHEN asked < 0 THEN NULL ELSE least(coalesce(asked, stored), stored, durable) END AS eff FROM q")
def vis_clamp(spark, sf):
    return asked(spark, sf).select("event_id", effective_bookmark(F.col("asked"), F.col("stored"), F.col("durable")).alias("eff"))


@query("vis_clamp_ingest", CLAMP + "SELECT event_id, CASE WHEN asked < 0 THEN NULL ELSE least(coalesce(asked, stored), stored, durable, ingested) END AS eff FROM q")
def vis_clamp_ingest(spark, sf):
    return asked(spark, sf).select("event_id", effective_bookmark(F.col("asked"), F.col("stored"), F.col("durable"), F.col("ingested")).alias("eff"))


@query("vis_label_clamp", "SELECT chapter_key, CASE WHEN revealed_at <= 25 THEN title ELSE '' END AS title, char_len FROM chapters WHERE book_id = 'src0'")
def vis_label_clamp(spark, sf):
    rows = bind(spark, sf, "chapters").where(F.col("book_id") == BOOK)
    return rows.select("chapter_key", F.when(F.col("revealed_at") <= BM + 1, F.col("title")).otherwise("").alias("title"), "char_len")


@query("vis_marks", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) <= 25")
def vis_marks(spark, sf):
    marks = spark.read.parquet(f"{sf}/events.parquet")
    return marks.where(F.get_json_object("props", "$.k").cast("int") <= BM + 1).select("event_id")


@query("vis_subchapter", "SELECT event_id, (k < 50 OR (k = 50 AND (event_id % 100) / 100.0 <= 0.5)) AS visible FROM reports")
def vis_subchapter(spark, sf):
    ends = (F.col("event_id") % 100) / 100.0
    return bind(spark, sf, "reports").select("event_id", ((F.col("k") < 50) | ((F.col("k") == 50) & (ends <= 0.5))).alias("visible"))


@query("flt_cast_query", VIS + """SELECT entity_id FROM ve WHERE contains(lower(canonical_name), '7')
  OR entity_id IN (SELECT entity_id FROM va WHERE contains(lower(surface), '7'))""")
def flt_cast_query(spark, sf):
    rows = at(spark, sf).graph()
    hit = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit("7")))
    return rows.where(F.contains(F.lower("canonical_name"), F.lit("7")) | hit).select("entity_id")


@query("flt_register", VIS + """SELECT edge_id, revealed_at FROM vr WHERE rel_type LIKE '1-%'
  AND (contains(lower(src_entity), '1') OR contains(lower(dst_entity), '1') OR contains(lower(label), '1') OR contains(lower(rel_type), 'x'))""")
def flt_register(spark, sf):
    q = lambda c, s="1": F.contains(F.lower(c), F.lit(s))
    rows = at(spark, sf).relationships().where(F.col("rel_type").startswith("1-"))
    return rows.where(q("src_entity") | q("dst_entity") | q("label") | q("rel_type", "x")).select("edge_id", "revealed_at").orderBy(F.desc("revealed_at"), "edge_id")


@query("flt_chapter_query", VIS + """, n AS (SELECT revealed_at, title AS t FROM vc UNION ALL SELECT revealed_at, body FROM vs WHERE kind = 'chapter' UNION ALL SELECT revealed_at, canonical_name FROM ve UNION ALL SELECT revealed_at, summary FROM vt)
SELECT chapter_key FROM vc WHERE revealed_at IN (SELECT revealed_at FROM n WHERE contains(lower(t), '0071'))""")
def flt_chapter_query(spark, sf):
    """The chapters whose title, summary, new names or events hold a text."""
    v, everyone = book(spark, sf), at(spark, sf)
    named = lambda df, c: df.select("revealed_at", F.col(c).alias("text"))
    found = chapters_with(" 0071", v.chapters(), named(v.rows("summaries").where("kind = 'chapter'"), "body"), named(everyone.entities(), "canonical_name"), named(everyone.timeline(), "summary"))
    return found.select("chapter_key")


@query("flt_jump_guard", """SELECT event_id, k > greatest(coalesce(max(k) OVER (PARTITION BY book_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) + 1 AS far FROM reports""")
def flt_jump_guard(spark, sf):
    before = Window.partitionBy("book_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("k").over(before), F.lit(0))
    return bind(spark, sf, "reports").select("event_id", (F.col("k") > F.greatest(seen, F.lit(0)) + 1).alias("far"))


@query("flt_audit", "SELECT event_id FROM reports WHERE book_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 200")
def flt_audit(spark, sf):
    rows = bind(spark, sf, "reports").where((F.col("book_id") % 3 == 1) & (F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp")))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


class Tenant:
    """Every table read through it carries the owner's predicate."""

    def __init__(self, owner: int):
        self.owner = owner

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("owner_id") == F.lit(self.owner))


@query("flt_rls", "SELECT event_id, k FROM reports WHERE book_id % 5 = 2")
def flt_rls(spark, sf):
    owned = bind(spark, sf, "reports").withColumn("owner_id", F.col("book_id") % 5)
    return Tenant(2).rows(owned).select("event_id", "k")


@query("flt_soft_delete", "SELECT chapter_key FROM chapters WHERE retracted_at IS NULL")
def flt_soft_delete(spark, sf):
    return bind(spark, sf, "chapters").where(F.col("retracted_at").isNull()).select("chapter_key")


@query("join_closure_semi", VIS + "SELECT alias_id, entity_id, surface FROM va")
def join_closure_semi(spark, sf):
    return at(spark, sf).aliases().select("alias_id", "entity_id", "surface")


@query("join_edges_both", VIS + "SELECT edge_id, src_entity, dst_entity, rel_type, revealed_at FROM vr")
def join_edges_both(spark, sf):
    """The flagship: the relationship graph as of a bookmark, closed over both ends."""
    return at(spark, sf).relationships().select("edge_id", "src_entity", "dst_entity", "rel_type", "revealed_at").orderBy("revealed_at", "edge_id")


@query("join_live_chapter_semi", VIS + "SELECT summary_id FROM vs WHERE chapter_key IN (SELECT chapter_key FROM vc)")
def join_live_chapter_semi(spark, sf):
    return book(spark, sf).of_live_chapters("summaries").select("summary_id")


@query("join_participants", VIS + "SELECT p.event_id, p.entity_id, p.role, e.canonical_name FROM vp p JOIN ve e ON e.entity_id = p.entity_id WHERE p.event_id IN (SELECT event_id FROM vt)")
def join_participants(spark, sf):
    return at(spark, sf).participants().select("event_id", "entity_id", "role", "canonical_name")


@query("join_events_for", VIS + "SELECT p.entity_id, p.event_id, p.role, t.summary FROM vp p JOIN vt t ON t.event_id = p.event_id WHERE p.entity_id IN (SELECT entity_id FROM ve)")
def join_events_for(spark, sf):
    return at(spark, sf).events_for().select("entity_id", "event_id", "role", "summary")


TIES = VIS + """, tt AS (SELECT src_entity AS entity_id, dst_entity AS other_id, rel_type, label, revealed_at, edge_id FROM vr
  UNION ALL SELECT dst_entity, src_entity, rel_type, label, revealed_at, edge_id FROM vr),
t1 AS (SELECT *, row_number() OVER (PARTITION BY entity_id, other_id ORDER BY revealed_at, edge_id) AS n FROM tt)
"""


@query("join_character_card", TIES + "SELECT t1.entity_id, other_id, canonical_name AS other_name, rel_type, label, edge_id FROM t1 JOIN ve ON ve.entity_id = other_id WHERE n = 1")
@query("gr_ties", TIES + "SELECT t1.entity_id, other_id, canonical_name AS other_name, rel_type, label, edge_id FROM t1 JOIN ve ON ve.entity_id = other_id WHERE n = 1")
def join_character_card(spark, sf):
    return at(spark, sf).ties().select("entity_id", "other_id", "other_name", "rel_type", "label", "edge_id")


RECEIPTED = VIS + """, rc AS (SELECT c.chapter_key, c.book_id, c.revealed_at, c.title FROM chapters c JOIN receipts r
  ON r.book_id = c.book_id AND r.chapter_key = c.chapter_key AND r.ordinal = c.revealed_at AND r.content_hash = c.content_hash WHERE c.retracted_at IS NULL)
"""


def receipted(spark, sf) -> DataFrame:
    c = bind(spark, sf, "chapters").where("retracted_at is null")
    r = bind(spark, sf, "receipts").withColumnRenamed("ordinal", "revealed_at")
    return c.join(r, ["book_id", "chapter_key", "revealed_at", "content_hash"])


@query("join_receipt_inner", RECEIPTED + "SELECT chapter_key, book_id, revealed_at FROM rc WHERE revealed_at <= 24")
def join_receipt_inner(spark, sf):
    return receipted(spark, sf).where(F.col("revealed_at") <= BM).select("chapter_key", "book_id", "revealed_at")


@query("join_edges_hosted", RECEIPTED + """SELECT e.edge_id, a.canonical_name AS src_name, b.canonical_name AS dst_name FROM edges e
  JOIN ve a ON a.entity_id = e.src_entity JOIN ve b ON b.entity_id = e.dst_entity
  JOIN rc ON rc.book_id = 'src0' AND rc.revealed_at = e.revealed_at
  WHERE e.revealed_at <= 24 AND e.retracted_at IS NULL AND (e.invalid_at IS NULL OR e.invalid_at > 24)""")
def join_edges_hosted(spark, sf):
    v = at(spark, sf)
    names = v.entities().select("entity_id", "canonical_name")
    a = names.toDF("src_entity", "src_name")
    b = names.toDF("dst_entity", "dst_name")
    done = receipted(spark, sf).where(F.col("book_id") == BOOK).select("revealed_at")
    return v.rows("edges").join(a, "src_entity").join(b, "dst_entity").join(done, "revealed_at").select("edge_id", "src_name", "dst_name")


@query("join_left_state", """SELECT b.book_id, coalesce(s.bookmark, 0) AS bookmark FROM (SELECT DISTINCT book_id FROM reports) b
  LEFT JOIN (SELECT book_id, max(k) AS bookmark FROM reports WHERE kind = 'purchase' GROUP BY 1) s ON s.book_id = b.book_id""")
def join_left_state(spark, sf):
    r = bind(spark, sf, "reports")
    state = r.where("kind = 'purchase'").groupBy("book_id").agg(F.max("k").alias("bookmark"), F.max("ts").alias("opened"))
    return r.select("book_id").distinct().join(state, "book_id", "left").orderBy(F.desc_nulls_last("opened"), "book_id").select("book_id", F.coalesce("bookmark", F.lit(0)).alias("bookmark"))


@query("join_left_raw", """SELECT r.chapter_key, r.ordinal, c.char_len FROM receipts r LEFT JOIN chapters c
  ON c.book_id = r.book_id AND c.chapter_key = r.chapter_key AND c.retracted_at IS NULL""")
def join_left_raw(spark, sf):
    r, c = bind(spark, sf, "receipts"), bind(spark, sf, "chapters")
    on = (r["book_id"] == c["book_id"]) & (r["chapter_key"] == c["chapter_key"]) & c["retracted_at"].isNull()
    return r.join(c, on, "left").select(r["chapter_key"], r["ordinal"], c["char_len"])


@query("join_cross_query", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z]+'), 'tion')")
def join_cross_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    one = spark.createDataFrame([("tion",)], "q string")  # one row, always
    return docs.join(F.broadcast(one), F.array_contains("w", F.col("q"))).select("doc_id")


@query("join_inventory", VIS + """SELECT e.edge_id FROM edges e JOIN ve a ON a.entity_id = e.src_entity JOIN ve b ON b.entity_id = e.dst_entity
  WHERE e.retracted_at IS NULL AND e.revealed_at <= 24 AND (e.invalid_at IS NULL OR e.invalid_at > 24) AND a.revealed_at < 24
  AND (e.src_entity IN ('c1', 'c2', 'c3', 'c4', 'c5', 'c6') OR e.dst_entity IN ('s1', 's2', 's3'))""")
def join_inventory(spark, sf):
    v = at(spark, sf)
    earlier = v.entities().where(F.col("revealed_at") < BM).select(F.col("entity_id").alias("src_entity"))
    rows = v.relationships().join(earlier, "src_entity", "left_semi")
    return rows.where(F.col("src_entity").isin("c1", "c2", "c3", "c4", "c5", "c6") | F.col("dst_entity").isin("s1", "s2", "s3")).select("edge_id")


@query("join_anti_uncovered", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_uncovered(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left_anti")


@query("join_anti_assignment", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS what
  FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d FULL JOIN (SELECT doc_id FROM labels) l ON l.doc_id = d.doc_id
  WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def join_anti_assignment(spark, sf):
    need = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0").select("doc_id")
    got = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id")
    return need.join(got, "doc_id", "left_anti").withColumn("what", F.lit("missing")).unionByName(got.join(need, "doc_id", "left_anti").withColumn("what", F.lit("extra")))


@query("join_manifest_store", "SELECT c.chapter_key FROM chapters c LEFT JOIN receipts r ON r.book_id = c.book_id AND r.ordinal = c.revealed_at WHERE r.chapter_key IS DISTINCT FROM c.chapter_key OR r.content_hash <> c.content_hash")
def join_manifest_store(spark, sf):
    c = bind(spark, sf, "chapters")
    r = bind(spark, sf, "receipts").select("book_id", F.col("ordinal").alias("revealed_at"), F.col("chapter_key").alias("r_key"), F.col("content_hash").alias("r_hash"))
    rows = c.join(r, ["book_id", "revealed_at"], "left")
    return rows.where(~F.col("r_key").eqNullSafe(F.col("chapter_key")) | (F.col("r_hash") != F.col("content_hash"))).select("chapter_key")


@query("join_toc_map", """, a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
t AS (SELECT page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, row_number() OVER (PARTITION BY regexp_extract(url, '/(en|de|fr|es)/', 1) ORDER BY page_id) AS rn FROM pages),
m AS (SELECT lang, max(rn) AS last FROM a GROUP BY 1)
SELECT t.page_id, a.doc_id FROM t JOIN m ON m.lang = t.lang JOIN a ON a.lang = t.lang AND a.rn = least(t.rn, m.last)""")
def join_toc_map(spark, sf):
    """The n-th repeat of a reference takes the n-th atom; beyond the last, the last."""
    a = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")))
    t = spark.read.parquet(f"{sf}/pages.parquet").withColumn("lang", F.regexp_extract("url", "/(en|de|fr|es)/", 1))
    t = t.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("page_id")))
    last = a.groupBy("lang").agg(F.max("rn").alias("last"))
    t = t.join(last, "lang").select("page_id", "lang", F.least("rn", "last").alias("rn"))
    return t.join(a.select("lang", "rn", "doc_id"), ["lang", "rn"]).select("page_id", "doc_id")


@query("join_name_resolution", """, f AS (SELECT lower(n_name) AS form, min(n_nationkey) AS id FROM nation GROUP BY 1)
SELECT s.s_suppkey, f.id AS src, g.id AS dst FROM supplier s LEFT JOIN f ON f.id = s.s_nationkey
 LEFT JOIN f g ON g.form = lower(CASE WHEN s.s_suppkey % 3 = 0 THEN 'nowhere' ELSE 'nation_1' END)""")
def join_name_resolution(spark, sf):
    forms = spark.read.parquet(f"{sf}/nation.parquet").groupBy(F.lower("n_name").alias("form")).agg(F.min("n_nationkey").alias("id"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("form", F.lower(F.when(F.col("s_suppkey") % 3 == 0, "nowhere").otherwise("nation_1")))
    src = forms.select(F.col("id").alias("s_nationkey"), F.col("id").alias("src"))
    return s.join(src, "s_nationkey", "left").join(forms.withColumnRenamed("id", "dst"), "form", "left").select("s_suppkey", "src", "dst")


@query("join_queue", """SELECT event_id FROM reports WHERE kind = 'click' AND book_id NOT IN (SELECT book_id FROM reports WHERE kind = 'purchase' AND k > 95)
  ORDER BY k DESC, ts, event_id LIMIT 1""")
@query("topk_queue", "SELECT event_id FROM reports WHERE kind = 'click' AND book_id NOT IN (SELECT book_id FROM reports WHERE kind = 'purchase' AND k > 95) ORDER BY k DESC, ts, event_id LIMIT 1")
def join_queue(spark, sf):
    r = bind(spark, sf, "reports")
    blocked = r.where("kind = 'purchase' and k > 95").select("book_id")
    return r.where("kind = 'click'").join(blocked, "book_id", "left_anti").orderBy(F.desc("k"), "ts", "event_id").limit(1).select("event_id")


@query("agg_catchup", VIS + """SELECT (SELECT body FROM vs2 ORDER BY revealed_at DESC, summary_id DESC LIMIT 1) AS recap,
  (SELECT count(*) FROM ve WHERE type = 'character') AS cast_size, (SELECT count(*) FROM vr) AS open_threads""".replace("vs2", f"(SELECT * FROM summaries WHERE {LIVE} AND kind = 'rolling-recap')"))
def agg_catchup(spark, sf):
    return at(spark, sf).catch_up()


@query("agg_notes", VIS + """, nc AS (SELECT revealed_at, string_agg(canonical_name, ', ' ORDER BY entity_id) AS newcomers FROM ve WHERE type = 'character' GROUP BY 1),
ev AS (SELECT revealed_at, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY order_idx, event_id) AS events FROM vt GROUP BY 1)
SELECT c.revealed_at, c.title, s.body, nc.newcomers, ev.events FROM vc c
 LEFT JOIN vs s ON s.chapter_key = c.chapter_key AND s.kind = 'chapter' LEFT JOIN nc ON nc.revealed_at = c.revealed_at LEFT JOIN ev ON ev.revealed_at = c.revealed_at""")
def agg_notes(spark, sf):
    v, m = book(spark, sf), at(spark, sf)
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ", " if value == "canonical_name" else ",")
    new = m.entities("character").groupBy("revealed_at").agg(ordered(["entity_id"], "canonical_name").alias("newcomers"))
    events = m.timeline().groupBy("revealed_at").agg(ordered(["order_idx", "event_id"], "event_id").alias("events"))
    s = v.rows("summaries").where("kind = 'chapter'").select("chapter_key", "body")
    return v.chapters().join(s, "chapter_key", "left").join(new, "revealed_at", "left").join(events, "revealed_at", "left").select("revealed_at", "title", "body", "newcomers", "events")


BIO = VIS + """, st AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY revealed_at DESC, state_id DESC) AS n FROM states
  WHERE revealed_at <= 24 AND retracted_at IS NULL AND (invalid_at IS NULL OR invalid_at > 24))
"""


@query("agg_bio", BIO + """SELECT ve.entity_id, canonical_name, ve.revealed_at AS first_seen,
 (SELECT string_agg(DISTINCT surface, '|' ORDER BY surface) FROM va WHERE va.entity_id = ve.entity_id) AS aliases, st.status_json,
 (SELECT string_agg(CAST(t.event_id AS VARCHAR), ',' ORDER BY t.event_id) FROM vp p JOIN vt t ON t.event_id = p.event_id WHERE p.entity_id = ve.entity_id) AS events
 FROM ve LEFT JOIN st ON st.entity_id = ve.entity_id AND n = 1 WHERE type = 'character'""")
def agg_bio(spark, sf):
    v = at(spark, sf)
    names = v.aliases().groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("surface")), "|").alias("aliases"))
    state = v.latest_state().select("entity_id", "status_json")
    events = v.events_for().groupBy("entity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("events"))
    rows = v.entities("character").join(names, "entity_id", "left").join(state, "entity_id", "left").join(events, "entity_id", "left")
    return rows.select("entity_id", "canonical_name", F.col("revealed_at").alias("first_seen"), "aliases", "status_json", "events")


@query("agg_graph", VIS + "SELECT ve.entity_id, canonical_name, (SELECT string_agg(DISTINCT surface, '|' ORDER BY surface) FROM va WHERE va.entity_id = ve.entity_id) AS aliases FROM ve")
def agg_graph(spark, sf):
    return at(spark, sf).graph().select("entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


@query("agg_cast", VIS + """, f AS (SELECT entity_id, canonical_name AS form, revealed_at, 0 AS rank FROM ve
 UNION ALL SELECT va.entity_id, surface, ve.revealed_at, 1 FROM va JOIN ve ON ve.entity_id = va.entity_id),
g AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY rank, revealed_at, entity_id) AS n FROM f) SELECT form, entity_id FROM g WHERE n = 1""")
def agg_cast(spark, sf):
    return at(spark, sf).cast()


@query("win_latest_state", BIO + "SELECT entity_id, state_id, status_json FROM st WHERE n = 1 AND entity_id IN (SELECT entity_id FROM ve)")
def win_latest_state(spark, sf):
    return at(spark, sf).latest_state().select("entity_id", "state_id", "status_json")


@query("gate_supplied_facts", VIS + """SELECT DISTINCT kind, text FROM (SELECT 'name' AS kind, canonical_name AS text FROM ve
 UNION ALL SELECT 'alias', surface FROM va UNION ALL SELECT 'event', summary FROM vt) u""")
def gate_supplied_facts(spark, sf):
    return at(spark, sf).supplied_facts()


@query("er_roster", VIS.replace("24", "23") + "SELECT ve.entity_id, canonical_name, type, (SELECT string_agg(DISTINCT surface, '|' ORDER BY surface) FROM va WHERE va.entity_id = ve.entity_id) AS aliases FROM ve")
def er_roster(spark, sf):
    return at(spark, sf, BM - 1).graph().select("entity_id", "canonical_name", "type", F.array_join("aliases", "|").alias("aliases"))


@query("agg_roster_text", VIS + """, l AS (SELECT revealed_at, entity_id, '- ' || canonical_name || ' [' || type || ']' || coalesce(' (aka ' || (SELECT string_agg(DISTINCT surface, ', ' ORDER BY surface) FROM va WHERE va.entity_id = ve.entity_id) || ')', '') AS line FROM ve WHERE type = 'character'),
c AS (SELECT DISTINCT revealed_at FROM chapters WHERE revealed_at <= 24) SELECT c.revealed_at, coalesce(string_agg(line, chr(10) ORDER BY entity_id), '(none yet — this is the first chapter)') AS roster FROM c LEFT JOIN l ON l.revealed_at = c.revealed_at GROUP BY 1""")
def agg_roster_text(spark, sf):
    """The characters that each chapter brings in, as lines of a prompt."""
    rows = at(spark, sf).graph().where("type = 'character'")
    return roster_text(rows, bind(spark, sf, "chapters").where(F.col("revealed_at") <= BM))