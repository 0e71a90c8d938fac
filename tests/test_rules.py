"""Ceilings, pins, commits, retractions, bundles, manifests, numbering and clustering quality on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions import text as X
from chronofold.operators import facts as K
from chronofold.operators import fulltext as T
from chronofold.operators import gates as G
from chronofold.operators import jobs as J
from chronofold.operators import ledger as L
from chronofold.operators import ordering as O
from chronofold.operators import resolve as R
from chronofold.operators.view import EMPTY_ROSTER, bookmark_literal, chapters_with, roster_text
from chronofold.sources import archive as A

USE = "book_id int, input_tokens long, output_tokens long, micro long"


def test_three_ceilings_in_order(spark):
    df = spark.createDataFrame
    ask = [(i, i, 10, 10, 10, *tops) for i, tops in enumerate([(30, 30, 30), (29, 29, 29), (30, 29, 29), (30, 30, 29), (None, None, None), (9, 10, 10)])]
    used = [(i, 10, 10, 10) for i in range(5)]
    got = L.projected(df(ask, "request_id int, book_id int, input_tokens long, output_tokens long, micro long, max_input long, max_output long, max_micro long"), df(used, USE), df(used, USE))
    assert {r.request_id: r.outcome for r in got.collect()} == {0: "ok", 1: "input", 2: "output", 3: "usd", 4: "ok", 5: "input"}


def test_pins(spark):
    df = spark.createDataFrame
    asked = df([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "a", 1)], "book_id int, space string, n int")
    got = {r.book_id: (r.pin, r.outcome) for r in L.pinned_first(asked, df([(2, "a"), (3, "z")], "book_id int, space string"), ["n"]).collect()}
    assert got == {1: ("b", "pinned"), 2: ("a", "kept"), 3: ("z", "conflict")}
    rows = df([(1, "a", None), (1, "b", 5), (2, "b", None), (3, None, None)], "book_id int, space string, retracted_at int")
    new = df([(1, "a"), (2, "a"), (3, "a"), (4, "a")], "book_id int, space string")
    assert {r.book_id: r.pin for r in L.repinned(new, rows).collect()} == {1: "a", 2: None, 3: None, 4: "a"}


def test_commits(spark):
    rows = [(1, "running", 100), (2, "running", 100), (3, "running", 100), (4, "running", 0)]
    jobs = spark.createDataFrame(rows, "job_id int, state string, t int").select(
        "job_id", "state", F.timestamp_seconds("t").alias("lease_until"), F.lit(7).alias("token"), F.lit(1).alias("attempt_count"), F.lit(7).alias("claim_token"), F.lit(1).alias("claim_attempt"),
        F.concat(F.lit("k"), F.col("job_id").cast("string")).alias("chapter_key"), F.lit("h").alias("content_hash"),
    )
    receipts = spark.createDataFrame([("k2", "h"), ("k3", "old"), ("k4", "old")], "chapter_key string, content_hash string")
    assert {r.job_id: r.outcome for r in J.commits(jobs, receipts, F.timestamp_seconds(F.lit(50))).collect()} == {1: "append", 2: "no-op", 3: "changed", 4: "lost"}


def test_retractions_cascade_once(spark):
    df = spark.createDataFrame
    table = df([("b", "k", 1, None), ("b", "k", 2, 5), ("b", "q", 3, None), ("c", "k", 4, None)], "book_id string, chapter_key string, id int, retracted_at int")
    gone = df([("b", "k", 9), ("b", "k", 7)], "book_id string, chapter_key string, at int")
    got = K.retract_chapters({"x": (table, "id"), "y": (table, "chapter_key")}, gone)
    assert sorted((r.kind, r.id, r.retracted_at) for r in got.collect()) == [("x", "1", 7), ("y", "k", 7)]


def test_bundles_are_bound_by_their_manifest(spark):
    a = spark.createDataFrame([(1, "x", bytearray(b"\1\2")), (1, "x", bytearray(b"\1\2")), (2, None, None)], "k int, t string, b binary")
    rows, manifest = A.export_bundle({"a": (a, "k")})
    schema = {"a": "k int, t string, b string"}
    assert sorted((r.k, r.t or "") for r in A.import_bundle(rows, manifest, schema)["a"].collect()) == [(1, "x"), (1, "x"), (2, "")]
    for bad_rows, bad_manifest, tables in (
        (rows, manifest.withColumn("version", F.lit(5)), schema), (rows, manifest.withColumn("format", F.lit("other")), schema), (rows, manifest, schema | {"b": "k int"}),
        (rows.distinct(), manifest, schema), (rows.withColumn("row", F.replace("row", F.lit("x"), F.lit("y"))), manifest, schema),
        (rows.unionByName(rows.limit(1).withColumn("name", F.lit("z"))), manifest, schema),
    ):
        with pytest.raises(A.ArchiveError):
            A.import_bundle(bad_rows, bad_manifest, tables)


def test_manifests_that_do_not_hold_are_left_out(spark):
    rows = [("b", i, f"k{i}", 5) for i in (1, 2, 3)] + [("gap", i, f"k{i}", 5) for i in (1, 3)] + [("bad", 1, "k", 5)]
    sent = A.manifest(spark.createDataFrame(rows, "book_id string, revealed_at int, chapter_key string, char_len long"))
    sent = sent.withColumn("manifest", F.when(F.col("book_id") == "bad", F.lit("{")).otherwise(F.col("manifest")))
    assert sorted((r.book_id, r.revealed_at) for r in A.read_manifest(sent).collect()) == [("b", 1), ("b", 2), ("b", 3)]
    assert {r.book_id for r in A.refused_manifests(sent).collect()} == {"gap", "bad"}


def test_records(spark):
    rows = spark.createDataFrame([(1, '[{"v":1},{"v":2,"z":3}]'), (2, "[]"), (3, None)], "id int, doc string")
    assert sorted((r.id, r.v) for r in A.records(rows, "doc", "v bigint").collect()) == [(1, 1), (1, 2)]


def test_numbering_by_range_splits_a_hot_key(spark):
    r = random.Random(1)
    values = r.sample(range(100_000), 6_000)
    rows = spark.createDataFrame([("hot" if i % 3 else r.choice(["a", "b", None]), v) for i, v in enumerate(values)], "k string, v int").repartition(5)
    got = O.numbered(rows, "k", "v").collect()
    want = {}
    for k, group in itertools.groupby(sorted(((x.k or "", x.v) for x in rows.collect())), key=lambda x: x[0]):
        want |= {v: n for n, (_, v) in enumerate(group, 1)}
    assert {x.v: x.n for x in got} == want


def test_digests_do_not_depend_on_order_but_on_every_row(spark):
    d = lambda *rows: O.multiset_digest(spark.createDataFrame([(x,) for x in rows], "p string").repartition(3), "p").first().digest
    assert d("a", "b", "c") == d("c", "a", "b")
    assert len({d("a", "b"), d("a"), d("a", "a"), d("a", "c"), d("ab"), d("a", "b", "b")}) == 6


def test_clustering_quality_equals_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.choice("abc"), r.choice("xyz")) for i in range(60)]
    got = O.pair_quality(spark.createDataFrame(rows, "id int, gold string, pred string").drop("id"), 0.3).first()
    pairs = list(itertools.combinations(rows, 2))
    tp = sum(a[1] == b[1] and a[2] == b[2] for a, b in pairs)
    fp, fn = sum(a[1] != b[1] and a[2] == b[2] for a, b in pairs), sum(a[1] == b[1] and a[2] != b[2] for a, b in pairs)
    assert (got.tp, got.fp, got.fn, got.over_merged, got.fragmented) == (tp, fp, fn, 3, 3)
    assert abs(got.f1 - 2 * tp / (2 * tp + fp + fn)) < 1e-12 and got.passed == (got.f1 >= 0.3)
    assert O.pair_quality(spark.createDataFrame([], "gold string, pred string"), 0.5).first().passed is False


def test_bookmark_literals(spark):
    sent = ["3", "-1", "0", "03", "3.0", '"3"', "true", "null", "", None, "1e3", "9" * 18, "9" * 30]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(sent)], "i int, s string").select("i", bookmark_literal(F.col("s")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [3, -1, 0, None, None, None, None, None, None, None, None, 10**18 - 1, None]


def test_honorifics_fold_into_the_only_bearer(spark):
    names = ["Father Zossima", "zossima", "Brother Karamazov", "Karamazov", "KARAMAZOV", "Doctor Zossima", "Elder  Zossima", "Father", None, "Mother Superior Zossima"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    assert sorted(tuple(r) for r in R.coalesce_honorifics(df).collect()) == [(0, 1), (6, 1)]


def test_limits_change_by_allowed_fields_only(spark):
    df = spark.createDataFrame
    limits = df([(1, 10, 1.5), (2, 10, 1.5), (3, 10, None)], "owner_id int, max_books long, max_spend_usd double")
    sent = df([(1, "max_books", 5.0, 1), (1, "max_books", 7.0, 2), (2, "max_books", 5.0, 1), (2, "owner_id", 9.0, 1), (4, "max_books", 1.0, 1)], "owner_id int, field string, value double, at int")
    got = {r.owner_id: (r.max_books, r.max_spend_usd, r.outcome) for r in L.updated_limits(limits, sent).collect()}
    assert got == {1: (7, 1.5, "updated"), 2: (10, 1.5, "refused"), 3: (10, None, "unchanged"), 4: (None, None, "unknown")}


def test_labels_that_mean_the_same(spark):
    labels = {"Father of": "father-child", "father–son relationship": "father-child", "Mother / daughter": "mother-child", "SIBLINGS tie": "siblings", "ties": "ties", "owes money to": "owes money to", "": "", None: None}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, s string").select("i", X.label_key(F.col("s")).alias("k")).orderBy("i")
    assert [r.k for r in df.collect()] == list(labels.values())


def test_differences_in_both_directions(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "a int, b int")
    assert tuple(O.multiset_difference(df((1, 1), (1, 1), (2, None)), df((1, 1), (2, None), (3, 3), (3, 3)), ["a", "b"]).first()) == (3, 4, 1, 2)
    assert tuple(O.multiset_difference(df(), df(), ["a", "b"]).first()) == (0, 0, 0, 0)


def test_rosters_and_chapter_search(spark):
    df = spark.createDataFrame
    roster = df([(2, "b", "Ann", "person", ["Annie", "Miss A"]), (2, "a", "Bo", "dog", []), (3, "c", "Cy", "person", None)], "revealed_at int, entity_id string, canonical_name string, type string, aliases array<string>")
    chapters = df([(i, f"Title {i}") for i in (1, 2, 3)], "revealed_at int, title string")
    assert {r.revealed_at: r.roster for r in roster_text(roster, chapters).collect()} == {1: EMPTY_ROSTER, 2: "- Bo [dog]\n- Ann [person] (aka Annie, Miss A)", 3: "- Cy [person]"}
    names = roster.select("revealed_at", F.col("canonical_name").alias("text"))
    events = df([(1, "A fire"), (3, None)], "revealed_at int, text string")
    find = lambda needle: sorted(r.revealed_at for r in chapters_with(needle, chapters, names, events).collect())
    assert (find("ann"), find(" FIRE "), find("title 3"), find("  "), find("zz")) == ([2], [1], [3], [1, 2, 3], [])


def test_reveal_stamps(spark):
    df = spark.createDataFrame
    seen = df([("ivan", 3), ("zossima", 5)], "word string, first_at int")
    names = df([("a", "Ivan", 3), ("b", "Father Zossima", 4), ("c", "Nobody", 1), ("d", "Ivan Zossima", 2), ("e", None, 1)], "owner string, name string, revealed_at int")
    assert {r.owner: (r.first_at, r.verdict) for r in G.reveal_stamps(names, seen).collect()} == {"a": (3, "ok"), "b": (5, "early"), "c": (None, "unread"), "d": (3, "early"), "e": (None, "unread")}


def test_sources_are_different_and_ranked(spark):
    rows = [(1, "a  b", 1.0), (2, "a b", 2.0), (3, " ", 9.0), (4, None, 9.0), (5, "x" * 3_000, 2.0), (6, "x" * 3_000 + "y", 0.5), (7, "c", 0.1)]
    got = T.sources(spark.createDataFrame(rows, "k int, text string, score double"), key="k", limit=3).orderBy("n").collect()
    assert [(r.n, r.k, len(r.passage)) for r in got] == [(1, 2, 3), (2, 5, 2_000), (3, 6, 2_000)]


def test_bindings_name_their_family(spark):
    text = lambda t: spark.createDataFrame([(1, t)], "id int, text string")
    got = lambda claim, fact: {r.signature for r in G.unsupported(text(claim), text(fact)).collect()}
    assert got("Ivan was murdered and Maria married him", "Maria at last married") == {"death:ivan"}
    assert got("Ivan married", "Ivan died") == {"union:ivan"}


@pytest.mark.parametrize("fact,held", [("das was at last murdered by someone", True), ("Es. das was murdered", True), ("all das was murdered", False), ("was murdered", False)])
def test_a_fact_may_begin_with_its_name_written_small(spark, fact, held):
    text = lambda t: spark.createDataFrame([(1, t)], "id int, text string")
    assert (G.unsupported(text("Das was at last murdered by someone"), text(fact)).count() == 0) == held


def test_a_mark_before_a_name_is_of_its_word(spark):
    text = spark.createDataFrame([("\u0301Das was murdered",)], "text string")
    assert text.select(G.signatures(F.col("text")).alias("s")).first()["s"] == []
