"""Sources and sinks: books, manifests, exports and backups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from chronofold.plans.registry import query
from chronofold.plans.standins import bind
from chronofold.sources import archive as A
from chronofold.sources import epub as E
from chronofold.sources.shared import fresh_path

BOOKS = ", b AS (SELECT 'book' || CAST(conv_id AS VARCHAR) AS path, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations) "


def books(spark, sf):
    """Conversations bound as EPUB files, one each, a chapter a turn; so books stay small and their number grows."""

    def bind_one(conv, texts: list[str]) -> bytes:
        return E.write([(f"c{i}.xhtml", f"Chapter {i + 1}", f"Chapter {i + 1}", t) for i, t in enumerate(texts)])

    return E.bind(spark.read.parquet(f"{sf}/conversations.parquet"), bind_one)


@query("src_epub", BOOKS + "SELECT path, position, length(regexp_replace(text, '\\s', '', 'g')) AS letters FROM b")
def src_epub(spark, sf):
    """A round trip: what was bound is read again, chapter by chapter."""
    rows = E.read(books(spark, sf)).where("error is null")
    body = F.regexp_replace("text", r"^Chapter \d+", "")
    return rows.select("path", F.col("position").cast("long").alias("position"), F.length(F.regexp_replace(body, r"\s", "")).cast("long").alias("letters"))


DRM = """SELECT DISTINCT 'book' || CAST(conv_id AS VARCHAR) AS path, CASE conv_id % 6 WHEN 2 THEN 'protected' WHEN 3 THEN 'protected' WHEN 4 THEN 'unsafe name' WHEN 5 THEN 'no end record' END AS error FROM conversations"""


@query("src_drm_check", DRM)
def src_drm_check(spark, sf):
    """Each conversation as a book: plain, with an obfuscated font, with an encrypted chapter, with a font that
    is not there, with an unsafe name, cut off. Refused ones become error rows."""
    listed = '<encryption><EncryptedData><EncryptionMethod Algorithm="{0}"/><CipherData><CipherReference URI="{1}"/></CipherData></EncryptedData></encryption>'

    def bind_one(conv, texts: list[str]) -> bytes:
        font = {"OPS/a.otf": "x", "META-INF/encryption.xml": listed.format(E.FONT_ALGORITHMS[0], "OPS/a.otf")}
        more = {
            1: font, 2: {"META-INF/encryption.xml": listed.format("http://www.w3.org/2001/04/xmlenc#aes128-cbc", "OPS/c.xhtml")},
            3: {"META-INF/Encryption.xml": listed.format(E.FONT_ALGORITHMS[1], "OPS/b.otf")}, 4: {"../evil": "x"},
        }.get(conv % 6)
        book = E.write([("c.xhtml", "One", "One", texts[0])], more=more)
        return book[:-30] if conv % 6 == 5 else book

    return E.read(E.bind(spark.read.parquet(f"{sf}/conversations.parquet"), bind_one)).select("path", "error")


HASH = "SELECT book_id, substring(sha256(string_agg(CAST(revealed_at AS VARCHAR) || ':' || chapter_key || ':' || CAST(char_len AS VARCHAR), '|' ORDER BY revealed_at)), 1, 16) AS hash FROM chapters GROUP BY 1"


@query("snk_manifest", HASH)
def snk_manifest(spark, sf):
    return A.manifest(bind(spark, sf, "chapters")).select("book_id", "hash")


@query("src_manifest", "SELECT book_id, revealed_at, chapter_key, char_len FROM chapters WHERE book_id NOT LIKE '%3'")
def src_manifest(spark, sf):
    """Manifests read back; those of some books were changed on their way and are refused."""
    sent = A.manifest(bind(spark, sf, "chapters"))
    return A.read_manifest(sent.withColumn("hash", F.when(F.col("book_id").endswith("3"), "changed").otherwise(F.col("hash"))))


@query("snk_portable", "SELECT c_custkey, '{\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"c_name\":\"' || c_name || '\"}' AS row FROM customer")
def snk_portable(spark, sf):
    return A.export_rows(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name"), "c_custkey")


@query("src_portable", "SELECT 'customer' AS name, c_custkey AS key, c_name AS text FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def src_portable(spark, sf):
    """Two tables as one bound bundle, verified and read back."""
    t = lambda n, *c: spark.read.parquet(f"{sf}/{n}.parquet").select(*c)
    rows, manifest = A.export_bundle({"customer": (t("customer", "c_custkey", "c_name"), "c_custkey"), "supplier": (t("supplier", "s_suppkey", "s_name"), "s_suppkey")})
    back = A.import_bundle(rows, manifest, {"customer": "c_custkey bigint, c_name string", "supplier": "s_suppkey bigint, s_name string"})
    each = [df.select(F.lit(n).alias("name"), F.col(df.columns[0]).alias("key"), F.col(df.columns[1]).alias("text")) for n, df in back.items()]
    return each[0].unionByName(each[1])


@query("src_recordset", "SELECT event_id, unnest([k, k + 1, event_id]) AS value FROM reports")
def src_recordset(spark, sf):
    """A JSON array in each row as rows."""
    sent = bind(spark, sf, "reports").select("event_id", F.format_string('[{"v":%d},{"v":%d},{"v":%d,"x":1}]', "k", F.col("k") + 1, "event_id").alias("doc"))
    return A.records(sent, "doc", "v bigint").select("event_id", F.col("v").alias("value"))


@query("snk_marks_export", "SELECT book_id, count(*) AS marks FROM reports WHERE kind = 'view' GROUP BY 1")
def snk_marks_export(spark, sf):
    """Marks as one versioned JSON document a book, read back for their number."""
    m = bind(spark, sf, "reports").where("kind = 'view'")
    doc = m.groupBy("book_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list(F.struct("event_id", "k"))).alias("marks"))).alias("doc"))
    return doc.select("book_id", F.json_array_length(F.get_json_object("doc", "$.marks")).cast("long").alias("marks"))


SAVED = "SELECT 'chapters' AS name, count(*) AS n, CAST(sum(char_len) AS BIGINT) AS total FROM chapters UNION ALL SELECT 'receipts', count(*), CAST(sum(ordinal) AS BIGINT) FROM receipts UNION ALL SELECT 'reports', count(*), CAST(sum(k) AS BIGINT) FROM reports"
MEASURE = {"chapters": "char_len", "receipts": "ordinal", "reports": "k"}


def saved(spark, sf):
    """A backup of three tables; its root."""
    root = fresh_path(spark, "backup")
    A.backup({n: bind(spark, sf, n) for n in MEASURE}, root)
    return root


def measured(spark, root):
    rows = [A.read(spark, root, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(c).cast("long").alias("total")) for n, c in MEASURE.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("snk_backup", SAVED)
def snk_backup(spark, sf):
    """Tables in one version with an inventory of digests, published by one marker."""
    return measured(spark, saved(spark, sf))


@query("snk_restore", SAVED)
def snk_restore(spark, sf):
    """A backup restored over an older version, which a restore that fails would have left in place."""
    archive, target = saved(spark, sf), fresh_path(spark, "restored")
    A.backup({n: bind(spark, sf, n).limit(1) for n in MEASURE}, target)
    A.restore(spark, archive, target, replace=True)
    return measured(spark, target)


@query("st_stream_high_water", """, e AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM reports),
m AS (SELECT book_id, max(epoch) AS epoch FROM e GROUP BY 1) SELECT m.book_id, CAST(m.epoch AS BIGINT) AS epoch, coalesce(max(k) FILTER (WHERE kind <> 'purchase'), 0) AS bookmark FROM m JOIN e ON e.book_id = m.book_id AND e.epoch = m.epoch GROUP BY 1, 2""")
def st_stream_high_water(spark, sf):
    """The stream's last state of each book; ``st_reset_epoch`` is its batch twin."""
    from chronofold.streaming import position as P

    out = P.run_once(P.high_water(P.reports(spark, sf)), fresh_path(spark, "stream"))
    return out.groupBy("book_id").agg(F.max(F.struct("epoch", "bookmark")).alias("s")).select("book_id", "s.epoch", "s.bookmark")


@query("st_rate_window", """, g AS (SELECT book_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY book_id ORDER BY ts, event_id) AS rn FROM reports),
f AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(-1 AS BIGINT) AS began, CAST(0 AS BIGINT) AS used FROM reports
UNION ALL SELECT g.book_id, g.rn, g.event_id, CASE WHEN began < 0 OR s - began >= 86400 THEN s ELSE began END, CASE WHEN began < 0 OR s - began >= 86400 THEN 1 ELSE used + 1 END FROM f JOIN g ON g.book_id = f.book_id AND g.rn = f.rn + 1)
SELECT event_id, used <= 3 AS allowed FROM f WHERE rn > 0""", recursive=True)
def st_rate_window(spark, sf):
    from chronofold.streaming import position as P

    out = P.run_once(P.request_windows(P.reports(spark, sf), 86_400, 3), fresh_path(spark, "stream"), "append")
    return out.select("event_id", "allowed")


@query("st_windowed_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_windowed_counts(spark, sf):
    """Tumbling windows in event time, complete output (an extension)."""
    from chronofold.streaming import position as P

    out = P.run_once(P.windowed_counts(P.reports(spark, sf)), fresh_path(spark, "stream"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
