"""What a book's own files tell: package, contents and types, chapters from the spine, anchors, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import text as X
from chronofold.operators import anchors as H
from chronofold.operators import sections as Z
from chronofold.operators import segment as S
from chronofold.plans.registry import query
from chronofold.sources import epub as E


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


# Paragraphs get ids p1, p2, ...; every other one is a boundary. Some pages repeat an id, others name one that is not there.
ANCHORS = r""", s AS (SELECT page_id, string_split(replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '<p>') AS parts FROM pages),
b AS (SELECT page_id, parts, unnest(list_concat([0], range(1, len(parts), 2))) AS i FROM s),
t AS (SELECT page_id, i, regexp_replace(regexp_replace(array_to_string(CASE WHEN i = 0 THEN parts[1:1] ELSE parts[i + 1 : i + 2] END, '<p>'), '^.*<body>', ''), '<(script|style)[^>]*>[^<]*</(script|style)>', '', 'g') AS part, len(parts) AS n FROM b),
x AS (SELECT page_id, CASE WHEN i = 0 THEN '' ELSE 'p' || CAST(i AS VARCHAR) END AS frag, page_id % 11 <> 5 AND NOT (page_id % 7 = 3 AND n > 2) AS sound,
 array_to_string(list_filter(string_split_regex(part, '<[^>]*>'), lambda v: regexp_matches(v, '\S')), ' ') AS body FROM t
 UNION ALL SELECT page_id, 'p0', false, '' FROM s WHERE page_id % 11 = 5)
SELECT page_id, frag, sound, CASE WHEN sound THEN body ELSE '' END AS text FROM x"""


def anchored(spark, sf):
    """Pages as documents with anchors, and the atoms that their tables of contents name."""
    parts = F.split("html", "<p>", -1)
    named = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit('<p id="p'), F.when((F.col("page_id") % 7 == 3) & (i == 2), 1).otherwise(i).cast("string"), F.lit('">'), p)))
    docs = pages(spark, sf).select(F.col("page_id").alias("doc"), F.array_join(named, "").alias("markup"), F.size(parts).alias("n"))
    odd = F.filter(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: (i % 2 == 1) & (i < F.col("n")))
    frags = F.concat(F.array(F.lit("")), F.transform(odd, lambda i: F.concat(F.lit("p"), i.cast("string"))), F.when(F.col("doc") % 11 == 5, F.array(F.lit("p0"))).otherwise(F.array()))
    return docs, docs.select("doc", F.explode(frags).alias("frag"))


@query("win_anchor_bucket", ANCHORS)
def win_anchor_bucket(spark, sf):
    """Each page split at the anchors that its contents name; a page with a missing or repeated one gives nothing."""
    docs, atoms = anchored(spark, sf)
    return H.bucket_by_anchor(H.elements(docs), atoms).withColumnRenamed("doc", "page_id")


SECTIONS = r""", p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1), '[?#].*$', '') AS path FROM pages),
s AS (SELECT page_id AS section, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN regexp_extract(path, '[^/]*$') ELSE 'EPUB/text/' || path END AS h FROM p),
a AS (SELECT page_id AS atom, CASE page_id % 2 WHEN 0 THEN 'text/' || path ELSE path END AS h FROM p WHERE path <> ''),
e AS (SELECT section, min(atom) AS atom FROM s JOIN a ON a.h = s.h GROUP BY 1),
c AS (SELECT section, min(atom) AS atom FROM s JOIN a ON s.h <> '' AND (ends_with(a.h, '/' || s.h) OR ends_with(s.h, '/' || a.h)) WHERE section NOT IN (SELECT section FROM e) GROUP BY 1 HAVING count(DISTINCT a.h) = 1),
o AS (SELECT atom, min(section) AS section FROM c WHERE atom NOT IN (SELECT atom FROM e) GROUP BY 1 HAVING count(*) = 1)
SELECT s.section, coalesce(e.atom, o.atom) AS atom FROM s LEFT JOIN e ON e.section = s.section LEFT JOIN o ON o.section = s.section"""


@query("join_section_atom", SECTIONS)
def join_section_atom(spark, sf):
    """Pages as a reader's sections, by whole paths, last pieces and longer paths, against pages as atoms."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1), "[?#].*$", "")
    rows = pages(spark, sf).select(F.lit("b").alias("book"), "page_id", path.alias("path"))
    of_section = F.when(F.col("page_id") % 3 == 0, F.col("path")).when(F.col("page_id") % 3 == 1, F.regexp_extract("path", "[^/]*$", 0)).otherwise(F.concat(F.lit("EPUB/text/"), "path"))
    of_atom = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("text/"), "path")).otherwise(F.col("path"))
    sections = rows.select("book", F.col("page_id").alias("section"), of_section.alias("href"))
    atoms = rows.where("path <> ''").select("book", F.col("page_id").alias("atom"), of_atom.alias("href"))
    return Z.section_atoms(sections, atoms).select("section", "atom")


# Twenty-five pages are a book; a page's place in it decides what its package and contents say of it. {g} is what the
# engine adds to a regular replacement to make it replace all.
SPINE = r"""SELECT *, CASE WHEN pos IN (3, 10, 24) THEN heading WHEN pos IN (15, 16) THEN '' ELSE regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' '{g}), '<[^>]*>', ' '{g}) END AS text,
 CASE pos WHEN 0 THEN 'Contents' WHEN 1 THEN 'Dramatis Personæ of Book I' WHEN 2 THEN 'Introduction by the editor' WHEN 3 THEN 'Part One' WHEN 4 THEN 'Глава 1' WHEN 5 THEN 'Notes' WHEN 6 THEN NULL
  WHEN 9 THEN NULL WHEN 10 THEN 'Book the Second' WHEN 14 THEN NULL WHEN 15 THEN NULL WHEN 19 THEN '第 19 章' WHEN 22 THEN 'Appendix: of names' WHEN 24 THEN 'Part XLII.' ELSE 'Chapter ' || CAST(pos AS {s}) END AS label
FROM (SELECT page_id, CAST(floor(page_id / 25) AS BIGINT) AS book, page_id % 25 AS pos, html, 'OPS/p' || CAST(page_id AS {s}) || CASE WHEN page_id % 25 = 21 THEN '-colophon' ELSE '' END || '.xhtml' AS href,
 CASE WHEN page_id % 25 = 15 THEN '' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS heading FROM {pages}) q"""


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def either(pattern: str, *columns: str) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches(lower({c}), {quoted(pattern)}), false)" for c in columns or ("label", "heading")) + ")"


SEG = ", sp AS (" + SPINE.format(g=", 'g'", s="VARCHAR", pages="pages") + f""" WHERE page_id % 25 <> 14),
cl AS (SELECT *, len(regexp_extract_all(text, '[^\\s]+')) AS words, length(text) AS chars, CASE
 WHEN pos = 5 AND book % 2 = 0 THEN 'front' WHEN pos = 12 AND book % 3 = 0 THEN 'body' WHEN pos = 7 THEN 'body' WHEN pos IN (6, 9) THEN 'front'
 WHEN regexp_matches(left(lower(text), 4000), '{X.START}') THEN 'front' WHEN {either(X.CAST)} THEN 'front'
 WHEN regexp_matches(lower(text), '{X.LICENCE}') THEN CASE WHEN {either(X.CHAPTER)} THEN 'body' ELSE 'back' END
 WHEN pos = 21 THEN 'front' WHEN {either(X.CHAPTER)} THEN 'body' WHEN {either(X.FRONT_LABEL)} OR {either(X.CAST_WHOLE)} OR {either(X.FRONT_LEAD)} THEN 'front' WHEN {either(X.BACK_LABEL)} THEN 'back' ELSE 'body' END AS part FROM sp),
zo AS (SELECT *, CASE WHEN lo IS NULL THEN 'none' WHEN pos < lo THEN 'front' WHEN pos > hi THEN 'back' ELSE 'body' END AS zone
 FROM (SELECT *, min(CASE WHEN part = 'body' THEN pos END) OVER (PARTITION BY book) AS lo, max(CASE WHEN part = 'body' THEN pos END) OVER (PARTITION BY book) AS hi FROM cl) z) """


def spine(spark, sf):
    """Pages as books: their spine, landmarks and tables of contents. In every fourth book each file holds two anchors."""
    rows = spark.sql(SPINE.format(g="", s="STRING", pages="{pages}"), pages=pages(spark, sf))
    book, pos = F.col("book"), F.col("pos")
    types = F.when((pos == 5) & (book % 2 == 0), F.array(F.lit("frontmatter"))).when((pos == 12) & (book % 3 == 0), F.array(F.lit("toc"), F.lit("bodymatter"))).when(pos == 7, F.array(F.lit("chapter")))
    docs = rows.select("page_id", "book", "pos", "href", "text", "heading", types.alias("types"), (~pos.isin(13, 14)).alias("linear"))
    marks = rows.where("pos in (6, 9)").select("book", "href", F.when(pos == 6, "guide").otherwise("nav").alias("kind"))
    listed = rows.where("label is not null").select("book", "pos", "href", "label")
    two = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("frag"), F.lit(leaf).alias("leaf")) for i, f, leaf in ((0, "", False), (1, "a", True), (2, "b", True))])
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("frag"), F.lit(True).alias("leaf")))
    toc = listed.select("*", F.explode(F.when(book % 4 == 1, two).otherwise(one)).alias("e"))
    return docs, marks, toc.select("book", (pos * 3 + F.col("e.i")).alias("pos"), "href", F.col("e.frag").alias("frag"), F.concat_ws(" ", "label", F.nullif(F.col("e.frag"), F.lit(""))).alias("label"), F.col("e.leaf").alias("leaf"))


def classified(spark, sf):
    docs, marks, toc = spine(spark, sf)
    return S.body_of(S.classified(docs, marks, toc)), toc


@query("seg_classify", SEG + "SELECT page_id, part FROM cl")
def seg_classify(spark, sf):
    """Pages by type tokens, navigation and guide, then by text, labels and names."""
    return classified(spark, sf)[0].select(F.regexp_extract("href", "p([0-9]+)", 1).cast("long").alias("page_id"), "part")


@query("seg_linear", "SELECT page_id FROM pages WHERE page_id % 25 <> 14")
def seg_linear(spark, sf):
    """What is outside the linear order stays only if the contents refer to it."""
    return classified(spark, sf)[0].select(F.regexp_extract("href", "p([0-9]+)", 1).cast("long").alias("page_id"))


@query("seg_divider", SEG + f"SELECT page_id, words < 200 AND {either(X.DIVIDER)} AS divider FROM cl")
def seg_divider(spark, sf):
    rows = classified(spark, sf)[0]
    return rows.select(F.regexp_extract("href", "p([0-9]+)", 1).cast("long").alias("page_id"), X.is_divider(F.col("words"), F.col("label"), F.col("heading")).alias("divider"))


@query("seg_mode", SEG + "SELECT book, CASE WHEN book % 4 = 1 AND 2 * count(label) > greatest(1, count(*)) * 1.3 THEN 'anchor-driven' ELSE 'file-driven' END AS mode FROM zo WHERE zone = 'body' GROUP BY 1")
def seg_mode(spark, sf):
    chapters, _ = S.segment(*spine(spark, sf))
    return chapters.select("book", "mode").distinct()


FOLD = SEG + f""", ti AS (SELECT *, coalesce(nullif(label, ''), nullif(heading, ''), '(untitled)') AS title FROM zo WHERE zone = 'body'),
di AS (SELECT *, words < 200 AND {either(X.DIVIDER, "title", "heading")} AS divider, {either(X.CHAPTER, "title", "heading")} AS ch FROM ti),
fo AS (SELECT *, divider OR words = 0 AND NOT ch AS folds FROM di),
gr AS (SELECT *, coalesce(min(CASE WHEN NOT folds THEN pos END) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), pos) AS into_ FROM fo),
ats AS (SELECT book, into_, arg_max(href, pos) AS href, arg_max(title, pos) AS title, CASE WHEN bool_or(NOT folds) THEN coalesce(string_agg(CASE WHEN folds AND divider AND title <> '(untitled)' THEN title END, ' · ' ORDER BY pos), '') ELSE '' END AS part_label,
 CAST(sum(CASE WHEN folds THEN chars ELSE greatest(1, chars) END) AS BIGINT) AS chars, count(*) AS files,
 CASE WHEN bool_or(NOT folds AND words = 0) THEN 'content-less' WHEN bool_or(NOT folds) THEN 'chapter' WHEN bool_or(divider AND chars > 0) THEN 'trailing divider' ELSE 'dropped' END AS fate FROM gr GROUP BY 1, 2) """


@query("win_divider_fold", FOLD + "SELECT book, href, title, part_label, chars, files, fate FROM ats")
def win_divider_fold(spark, sf):
    """Dividers and blank pages joined to the chapters after them, trailing ones judged by themselves."""
    rows = classified(spark, sf)[0].where("zone = 'body'")
    return S.folded(rows).select("book", "href", "title", "part_label", "chars", F.size("files").cast("long").alias("files"), "fate")


@query("seg_flags", FOLD + f""", fl AS (SELECT book, fate AS flag FROM ats WHERE fate <> 'chapter' AND book % 4 <> 1
 UNION ALL SELECT book, 'dropped' FROM zo, (VALUES ('a'), ('b')) v(f) WHERE book % 4 = 1 AND zone = 'body' AND label IS NOT NULL AND ({either(X.CAST, "label")} OR (NOT {either(X.CHAPTER, "label || ' ' || f")} AND ({either(X.FRONT_LEAD, "label")})))
 UNION ALL SELECT book, 'no body' FROM zo WHERE zone = 'none' UNION ALL SELECT book, 'licence appended' FROM zo WHERE part = 'body' AND regexp_matches(lower(text), '{X.LICENCE}')
 UNION ALL SELECT book, 'ambiguous front' FROM zo WHERE zone = 'front' AND {either(X.FRONT_LEAD)} UNION ALL SELECT book, 'ambiguous back' FROM zo WHERE zone = 'back' AND {either(X.BACK_LABEL)}
 UNION ALL SELECT book, 'coverage gap' FROM zo z WHERE zone = 'body' AND book % 4 = 1 AND (label IS NULL OR {either(X.CAST, "label")} OR (NOT {either(X.CHAPTER, "label")} AND {either(X.FRONT_LEAD, "label")}))
 UNION ALL SELECT g.book, 'coverage gap' FROM gr g JOIN ats ON ats.book = g.book AND ats.into_ = g.into_ WHERE ats.fate = 'dropped' AND g.book % 4 <> 1)
SELECT book, flag, count(*) AS n, flag IN ('no body', 'coverage gap') AS gating FROM fl GROUP BY 1, 2""")
def seg_flags(spark, sf):
    """What a segmentation leaves to be looked at, and whether it stops the ingestion."""
    return S.segment(*spine(spark, sf))[1]


def bound(spark, sf):
    """Conversations as books: every other one with a navigation document in place of the older table, its later turns below its first."""

    def bind_one(conv, texts: list[str]) -> bytes:
        docs = [(f"c{i}.xhtml", f"Chapter {i + 1}", f"Chapter {i + 1}", t, *(["frontmatter chapter"] if i == 1 else [])) for i, t in enumerate(texts)]
        below = [(f"c{i}.xhtml#s{i}", f"Chapter {i + 1}", []) for i in range(1, len(docs))]
        return E.write(docs, f"Book {conv}", guide=["c0.xhtml"] if conv % 3 == 0 else [], nav="nav.xhtml" if conv % 2 else None, toc=[("c0.xhtml", "Chapter 1", below)])

    return E.bind(spark.read.parquet(f"{sf}/conversations.parquet"), bind_one)


TURNS = ", b AS (SELECT conv_id, 'book' || CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations) "


@query("src_opf", TURNS + """SELECT path, 'Book ' || CAST(conv_id AS VARCHAR) AS title, 'en' AS language, CASE WHEN conv_id % 2 = 1 THEN '3.0' ELSE '2.0' END AS version, CASE WHEN conv_id % 2 = 1 THEN 'OPS/nav.xhtml' END AS nav,
 CASE WHEN conv_id % 2 = 0 THEN 'OPS/t.ncx' END AS ncx, CASE WHEN conv_id % 3 = 0 THEN 'OPS/c0.xhtml' ELSE '' END AS guide, CAST(count(*) AS INT) AS spine FROM b GROUP BY conv_id, path""")
def src_opf(spark, sf):
    return E.packages(bound(spark, sf)).select("path", "title", "language", "version", "nav", "ncx", F.array_join("guide", ",").alias("guide"), "spine")


@query("src_toc", TURNS + """SELECT path, CAST(n AS INT) AS position, CASE WHEN n = 1 THEN '1' ELSE '1.' || CAST(n - 1 AS VARCHAR) END AS place, 'OPS/c' || CAST(n - 1 AS VARCHAR) || '.xhtml' AS href,
 CASE WHEN n = 1 THEN '' ELSE 's' || CAST(n - 1 AS VARCHAR) END AS frag, 'Chapter ' || CAST(n AS VARCHAR) AS label, n > 1 OR turns = 1 AS leaf FROM b""")
def src_toc(spark, sf):
    return E.toc(bound(spark, sf))


@query("src_epubtype", TURNS + "SELECT path, CAST(n AS INT) AS position, CASE WHEN n = 2 THEN 'frontmatter chapter' ELSE '' END AS types FROM b")
def src_epubtype(spark, sf):
    return E.read(bound(spark, sf)).select("path", "position", F.array_join("types", " ").alias("types"))
