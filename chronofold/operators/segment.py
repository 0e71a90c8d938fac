"""A book's spine into chapters: classification by its package's own signals, folded dividers, anchors, flags.

Inputs are tables over many books: ``spine`` (``book, pos, href, text, heading, types, linear``), ``landmarks``
(``book, href, kind``: ``nav`` or ``guide``) and ``toc`` (``book, pos, href, frag, label, leaf``; a tree that is
flattened by its source). Windows run within a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import text as X

ANCHORED_FROM = 1.3  # Fixed value: leaves a body file from which on anchors, not files, are the chapters.
UNTITLED = "(untitled)"


def classified(spine: DataFrame, landmarks: DataFrame, toc: DataFrame) -> DataFrame:
    """The spine in reading order with ``label, words, chars, part``; repeated files keep their first place. A document
    outside the linear order stays only where the table of contents refers to it. The first label
    without a fragment is a file's."""
    named = toc.groupBy("book", "href").agg(
        F.min_by(F.when(F.coalesce("frag", F.lit("")) == "", F.col("label")), F.when(F.coalesce("frag", F.lit("")) == "", F.col("pos"))).alias("label"),
        F.lit(True).alias("listed"),
    )
    kind = lambda k: F.bool_or(F.col("kind") == k)
    marks = landmarks.groupBy("book", "href").agg(kind("nav").alias("is_nav"), kind("guide").alias("in_guide"))
    first = F.row_number().over(Window.partitionBy("book", "href").orderBy("pos"))
    rows = spine.withColumn("nth", first).where("nth = 1").drop("nth").join(named, ["book", "href"], "left").join(marks, ["book", "href"], "left")
    rows = rows.where(F.coalesce("linear", F.lit(True)) | F.coalesce("listed", F.lit(False)))
    part = X.classify(F.col("href"), F.col("text"), F.col("label"), F.col("types"), F.col("heading"), F.col("is_nav"), F.col("in_guide"))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "book", "pos", "href", "text", "heading", "label", F.regexp_count(text, F.lit(r"\S+")).alias("words"), F.length(text).cast("long").alias("chars"), part.alias("part")
    )


def body_of(rows: DataFrame) -> DataFrame:
    """``rows`` with ``zone``: front before the first body document of the book, back after the last, body between, none without one."""
    at = F.when(F.col("part") == "body", F.col("pos"))
    w = Window.partitionBy("book")
    rows = rows.withColumn("lo", F.min(at).over(w)).withColumn("hi", F.max(at).over(w))
    zone = F.when(F.col("lo").isNull(), "none").when(F.col("pos") < F.col("lo"), "front").when(F.col("pos") > F.col("hi"), "back").otherwise("body")
    return rows.withColumn("zone", zone).drop("lo", "hi")


def folded(body: DataFrame) -> DataFrame:
    """File-driven chapters: ``book, ordinal, href, title, part_label, chars, files, fate``.

    A divider, or a page without text and without a chapter's label, joins the chapter after it and lends it its
    characters; dividers lend their titles as ``part_label`` too. With no chapter after it, a divider with
    text is a chapter of its own (fate ``trailing divider``); anything else goes (``dropped``, no ordinal). A page
    without text whose label is a chapter's stays, as ``content-less``.
    """
    title = F.coalesce(F.nullif("label", F.lit("")), F.nullif("heading", F.lit("")), F.lit(UNTITLED))
    rows = body.withColumn("title", title)
    divider = X.is_divider(F.col("words"), F.col("title"), F.col("heading"))
    empty = F.col("words") == 0
    rows = rows.withColumn("divider", divider).withColumn("folds", divider | (empty & ~X.is_chapter(F.col("title"), F.col("heading"))))
    onward = Window.partitionBy("book").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("into", F.first(F.when(~F.col("folds"), F.col("pos")), True).over(onward))
    rows = rows.withColumn("into", F.coalesce("into", "pos"))  # trailing ones stand alone
    own = ~F.col("folds")
    parts = F.array_sort(F.collect_list(F.when(F.col("divider") & F.col("folds") & (F.col("title") != UNTITLED), F.struct("pos", "title"))))
    of_main = lambda c: F.max_by(c, "pos")  # noqa: E731  (the chapter is the last of its group)
    out = rows.groupBy("book", "into").agg(
        of_main("href").alias("href"), of_main("title").alias("title"), F.transform(parts, lambda p: p["title"]).alias("parts"),
        F.sum(F.when(own, F.greatest("chars", F.lit(1))).otherwise(F.col("chars"))).alias("chars"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda p: p["href"]).alias("files"),
        F.bool_or(own).alias("chapter"), F.bool_or(F.col("divider") & (F.col("chars") > 0)).alias("some"), F.bool_or(own & empty).alias("bare"),
    )
    fate = F.when(F.col("chapter") & F.col("bare"), "content-less").when(F.col("chapter"), "chapter").when(F.col("some"), "trailing divider").otherwise("dropped")
    out = out.withColumn("fate", fate)
    n = F.sum((F.col("fate") != "dropped").cast("int")).over(Window.partitionBy("book").orderBy("into"))
    label = F.when(F.col("chapter"), F.array_join("parts", " · ")).otherwise("")
    return out.select("book", F.when(F.col("fate") != "dropped", n).alias("ordinal"), "href", "title", label.alias("part_label"), "chars", "files", "fate")


def leaves(toc: DataFrame, body: DataFrame) -> DataFrame:
    """The leaves of the table of contents that lie in body files: ``book, pos, href, frag, label, chars``."""
    files = body.select("book", "href", "chars")
    return toc.where("leaf").join(files, ["book", "href"]).select("book", "pos", "href", F.coalesce("frag", F.lit("")).alias("frag"), "label", "chars")


def anchored(listed: DataFrame) -> DataFrame:
    """Anchor-driven chapters of ``leaves``: one a leaf, a file's characters shared evenly among its leaves. Front matter and
    licences among the leaves go (fate ``dropped``); of repeated anchors the first counts."""
    first = F.row_number().over(Window.partitionBy("book", "href", "frag").orderBy("pos"))
    label = F.lower(F.coalesce("label", F.lit("")))
    front = label.rlike(X.CAST) | (~X.is_chapter(F.col("label")) & label.rlike("|".join((X.FRONT_LABEL, X.CAST_WHOLE, X.FRONT_LEAD))))
    gone = front | label.rlike(X.LICENCE) | label.contains("project gutenberg")
    rows = listed.withColumn("nth", first).where("nth = 1").withColumn("gone", gone)
    kept = (~F.col("gone")).cast("int")
    rows = rows.withColumn("ordinal", F.sum(kept).over(Window.partitionBy("book").orderBy("pos"))).withColumn("of", F.sum(kept).over(Window.partitionBy("book", "href")))
    chars = F.greatest(F.lit(1), F.floor(F.col("chars") / F.greatest("of", F.lit(1))))
    return rows.select(
        "book", F.when(~F.col("gone"), F.col("ordinal")).alias("ordinal"), F.when(F.col("frag") == "", F.col("href")).otherwise(F.concat_ws("#", "href", "frag")).alias("href"),
        F.coalesce(F.nullif("label", F.lit("")), F.lit(UNTITLED)).alias("title"), F.lit("").alias("part_label"), chars.cast("long").alias("chars"),
        F.array("href").alias("files"), F.when(F.col("gone"), "dropped").otherwise("anchor").alias("fate"),
    )


def segment(spine: DataFrame, landmarks: DataFrame, toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All books' chapters (with ``mode``), and their flags: ``book, flag, n, gating``."""
    rows = body_of(classified(spine, landmarks, toc))
    body = rows.where("zone = 'body'")
    listed = leaves(toc, body)
    files = body.groupBy("book").agg(F.count(F.lit(1)).alias("files"))
    modes = files.join(listed.groupBy("book").agg(F.count(F.lit(1)).alias("leaves")), "book", "left")
    many = F.coalesce("leaves", F.lit(0)) > F.greatest(F.lit(1), F.col("files")) * ANCHORED_FROM
    modes = modes.select("book", F.when(many, "anchor-driven").otherwise("file-driven").alias("mode"))
    of = lambda df, mode: df.join(modes.where(F.col("mode") == mode), "book")
    by_file, by_anchor = folded(of(body, "file-driven").drop("mode")), anchored(of(listed, "anchor-driven").drop("mode"))
    fates = by_file.withColumn("mode", F.lit("file-driven")).unionByName(by_anchor.withColumn("mode", F.lit("anchor-driven")))
    chapters = fates.where("fate <> 'dropped'")

    covered = chapters.select("book", F.explode("files").alias("href")).distinct().withColumn("covered", F.lit(True))
    seen = rows.join(covered, ["book", "href"], "left")
    ambiguous = lambda pattern: F.lower(F.concat_ws("\n", "label", "heading")).rlike("(?m)" + pattern)
    flag = F.array_compact(F.array(
        F.when(F.col("zone") == "none", F.lit("no body")),
        F.when((F.col("zone") == "body") & F.col("covered").isNull(), F.lit("coverage gap")),
        F.when((F.col("part") == "body") & F.lower("text").rlike(X.LICENCE), F.lit("licence appended")),
        F.when((F.col("zone") == "front") & ambiguous(X.FRONT_LEAD), F.lit("ambiguous front")),
        F.when((F.col("zone") == "back") & ambiguous(X.BACK_LABEL), F.lit("ambiguous back")),
    ))
    of_rows = seen.select("book", F.explode(flag).alias("flag"))
    of_fates = fates.where("fate in ('dropped', 'content-less', 'trailing divider')").select("book", F.col("fate").alias("flag"))
    flags = of_rows.unionByName(of_fates).groupBy("book", "flag").agg(F.count(F.lit(1)).alias("n"))
    return chapters, flags.withColumn("gating", F.col("flag").isin("no body", "coverage gap"))
