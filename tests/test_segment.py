"""Segmentation of books: which signal decides, trees of contents, anchors as chapters, refused packages."""

import pytest

from chronofold.operators import segment as S
from chronofold.sources import epub as E

BODY = "It was a long evening and nobody spoke. " * 30


def books(spark, **made):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")


def tables(files):
    spine = E.read(files).where("error is null").selectExpr("path AS book", "position AS pos", "href", "text", "heading", "types", "linear")
    return spine, E.landmarks(E.packages(files)).withColumnRenamed("path", "book"), E.toc(files).selectExpr("path AS book", "position AS pos", "href", "frag", "label", "leaf")


def parts(spark, content):
    return {r.href.rpartition("/")[2]: r.part for r in S.classified(*tables(books(spark, b=content))).collect()}


def test_types_navigation_and_guide_each_decide_a_page(spark):
    page = ("x.xhtml", "Chapter 3", "Chapter 3", BODY)
    others = [("c1.xhtml", "Chapter 1", "Chapter 1", BODY)]
    assert parts(spark, E.write([*others, page]))["x.xhtml"] == "body"
    assert parts(spark, E.write([*others, (*page, "frontmatter")]))["x.xhtml"] == "front"
    assert parts(spark, E.write([*others, (*page, "appendix")]))["x.xhtml"] == "back"
    assert parts(spark, E.write([*others, (*page, "toc bodymatter")]))["x.xhtml"] == "body"
    assert parts(spark, E.write([*others, page], guide=["x.xhtml#top"]))["x.xhtml"] == "front"
    as_nav = parts(spark, E.write([*others, ("nav.xhtml", "", "", "")], nav="nav.xhtml"))
    assert as_nav["nav.xhtml"] == "front" and as_nav["c1.xhtml"] == "body"
    # A type of the body outranks the guide, and any type outranks the label.
    assert parts(spark, E.write([*others, (*page, "chapter")], guide=["x.xhtml"]))["x.xhtml"] == "body"
    assert parts(spark, E.write([*others, ("x.xhtml", "Preface", "Preface", BODY, "chapter")]))["x.xhtml"] == "body"


@pytest.mark.parametrize("label,part", [
    ("Dramatis Personæ of Book I", "front"), ("Persons Represented in Act I", "front"), ("Characters", "front"), ("Cast Away", "body"),
    ("Introduction by the editor", "front"), ("Introduction to Part Two", "body"), ("Index", "back"), ("Index Case", "body"), ("Глава 2", "body"),
    ("第三章", "body"), ("действующие лица", "front"), ("登場人物", "front"), ("Notes on the text", "front"), ("Book Learning", "body"), ("Appendices", "back"), ("XIV. The storm", "body"),
])
def test_labels(spark, label, part):
    assert parts(spark, E.write([("c1.xhtml", "Chapter 1", "Chapter 1", BODY), ("q.xhtml", label, "", BODY)]))["q.xhtml"] == part


def test_contents_keep_order_fragments_and_leaves(spark):
    tree = [("a.xhtml", "One", [("a.xhtml#x", "One X", []), ("b.xhtml#y", "One Y", [("b.xhtml#z", "Deep & last", [])])]), ("c.xhtml", "Two", [])]
    docs = [(f"{n}.xhtml", n, n, BODY) for n in "abc"]
    want = [("1", "a.xhtml", "", "One", False), ("1.1", "a.xhtml", "x", "One X", True), ("1.2", "b.xhtml", "y", "One Y", False), ("1.2.1", "b.xhtml", "z", "Deep & last", True), ("2", "c.xhtml", "", "Two", True)]
    for nav in (None, "nav.xhtml"):
        got = E.toc(books(spark, b=E.write(docs, nav=nav, toc=tree))).orderBy("position").collect()
        assert [(r.place, r.href.removeprefix("OPS/"), r.frag, r.label, r.leaf) for r in got] == want


def test_only_the_contents_bring_back_what_lies_aside(spark):
    docs = [("a.xhtml", "Chapter 1", "Chapter 1", BODY), ("m.xhtml", "Map", "Map", BODY), ("n.xhtml", "Note", "Note", BODY)]
    toc = [("a.xhtml", "Chapter 1", []), ("n.xhtml", "Note", [])]
    assert set(parts(spark, E.write(docs, aside=["m.xhtml", "n.xhtml"], toc=toc))) == {"a.xhtml", "n.xhtml"}


def test_many_leaves_a_file_make_anchors_the_chapters(spark):
    docs = [("all.xhtml", "", "", BODY), ("c2.xhtml", "", "", BODY)]
    toc = [("all.xhtml#cast", "Dramatis Personae", []), *[(f"all.xhtml#c{i}", f"Chapter {i}", []) for i in range(1, 5)], ("all.xhtml#c2", "Chapter 2 again", []), ("c2.xhtml", "The Project Gutenberg license", [])]
    chapters, flags = S.segment(*tables(books(spark, b=E.write(docs, toc=toc))))
    got = chapters.orderBy("ordinal").collect()
    assert [(r.ordinal, r.href.removeprefix("OPS/"), r.title, r.mode) for r in got] == [(i, f"all.xhtml#c{i}", f"Chapter {i}", "anchor-driven") for i in range(1, 5)]
    n = next(r.chars for r in S.classified(*tables(books(spark, b=E.write(docs, toc=toc)))).collect() if r.href.endswith("all.xhtml"))
    assert {r.chars for r in got} == {n // 4}
    assert {(r.flag, r.n, r.gating) for r in flags.collect()} == {("dropped", 2, False), ("coverage gap", 1, True)}


def test_dividers_and_blank_pages_fold_forward(spark):
    docs = [
        ("p1.xhtml", "Part One", "", "PART ONE"), ("blank.xhtml", "", "", ""), ("c1.xhtml", "Chapter 1", "", BODY), ("c2.xhtml", "Chapter 2", "", ""),
        ("p2.xhtml", "Book the Second", "", "BOOK THE SECOND"), ("c3.xhtml", "Chapter 3", "", BODY), ("p3.xhtml", "Part III", "", "PART III"),
    ]
    chapters, flags = S.segment(*tables(books(spark, b=E.write(docs, toc=[(d[0], d[1], []) for d in docs if d[1]]))))
    got = [(r.ordinal, r.title, r.part_label, len(r.files), r.fate) for r in chapters.orderBy("ordinal").collect()]
    assert got == [(1, "Chapter 1", "Part One", 3, "chapter"), (2, "Chapter 2", "", 1, "content-less"), (3, "Chapter 3", "Book the Second", 2, "chapter"), (4, "Part III", "", 1, "trailing divider")]
    assert {r.flag for r in flags.collect()} == {"content-less", "trailing divider"}


def test_broken_packages_are_error_rows(spark):
    files = books(spark, cut=E.write([("a.xhtml", "A", "A", BODY)])[:-10], fine=E.write([("a.xhtml", "A", "A", BODY)]), none=b"")
    got = {r.path: r.error for r in E.packages(files).collect()}
    assert got["fine"] is None and got["cut"] and got["none"]
    assert {r.path for r in E.toc(files).collect()} == {"fine"}
    assert E.type_tokens('<html><body><section epub:type="Chapter"><article epub:type="bodymatter x"><section epub:type="appendix"></section></article></section></body></html>') == ["chapter", "bodymatter", "x"]


def test_books_are_bound_and_read_a_few_at_a_time(spark):
    """A worker gets no batch of thousands of books."""
    turns = spark.createDataFrame([(c, t, f"text {c} {t} <&>") for c in range(250) for t in (2, 0, 1)] + [(900, None, "last"), (900, 4, "first")], "conv_id long, turn long, text string")
    files = E.bind(turns.repartition(2), lambda conv, texts: E.write([(f"c{i}.xhtml", "L", "H", t) for i, t in enumerate(texts)], f"Book {conv}"))
    read = E.read(files)
    got = {(x.path, x.position): (x.title, x.text) for x in read.collect()}
    want = {(f"book{c}", t + 1): (f"Book {c}", f"H\ntext {c} {t} <&>") for c in range(250) for t in range(3)}
    assert got == want | {("book900", 1): ("Book 900", "H\nfirst"), ("book900", 2): ("Book 900", "H\nlast")}
    for out in (read, E.toc(files), E.packages(files)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "InPandas" not in plan and "ArrowEvalPython" not in plan
