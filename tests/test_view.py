"""The as-of contract: adversarial rows, guards, canaries, plans."""

import pytest
from pyspark.sql import functions as F

from chronofold.operators import gates, ledger, ordering
from chronofold.operators.facts import fold_changes, shortest_paths
from chronofold.operators.vectors import search
from chronofold.operators.view import Memory, strict_bookmark, visible
from chronofold.plans.queries_views import memory

FACT = "entity_id string, canonical_name string, type string, revealed_at int, invalid_at int, retracted_at timestamp"


@pytest.mark.parametrize("bad", [True, None, "3", 2.0])
def test_bookmark_is_a_strict_int(bad):
    with pytest.raises(ValueError):
        strict_bookmark(bad)


def test_unknown_table_is_refused(spark):
    with pytest.raises(ValueError):
        Memory(secrets=spark.range(1))


def test_adversarial_rows(spark):
    e = spark.createDataFrame([("a", "A", "character", 1, None, None), ("late", "L", "character", 30, None, None), ("ended", "E", "character", 1, 4, None)], FACT)
    alias = spark.createDataFrame([(1, "a", "Al", 2, None), (2, "late", "Spoiler", 3, None)], "alias_id int, entity_id string, surface string, revealed_at int, retracted_at timestamp")
    m = Memory(entities=e, aliases=alias)
    assert {r.surface for r in m.view(5).aliases().collect()} == {"Al"}
    assert {r.entity_id for r in m.view(3).entities().collect()} == {"a", "ended"}
    assert {r.entity_id for r in m.view(4).entities().collect()} == {"a"}


def test_every_bookmark_is_closed(spark, sf):
    m = memory(spark, sf)
    for bookmark in (0, 1, 40, 80):
        v = m.view(bookmark)
        ids = {r.entity_id for r in v.entities().collect()}
        assert all(r.src_entity in ids and r.dst_entity in ids and r.revealed_at <= bookmark for r in v.relationships().collect())


def test_predicate_reaches_the_scan(spark, sf):
    plan = visible(spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("revealed_at", F.col("label")), 3)
    assert "PushedFilters: [IsNotNull(label), LessThanOrEqual(label,3)]" in plan._jdf.queryExecution().executedPlan().toString()


def test_nearest_future_row_is_not_the_answer(spark):
    c = spark.createDataFrame([("k1", [1.0, 0.0], 9), ("k2", [0.6, 0.8], 1), ("k3", [0.0, 0.0], 1)], "chapter_key string, vec array<double>, revealed_at int")
    assert [r.chapter_key for r in search(visible(c, 2), [1.0, 0.0], 1).collect()] == ["k2"]
    assert search(visible(c, 2), [1.0, 0.0], 0).count() == 0


def test_fold_and_frontier(spark):
    ch = spark.createDataFrame([("x", "assert", 3, 1), ("x", "end", 9, 2), ("x", "end", 7, 3)], "fact_id string, op string, at int, recorded_at int")
    assert tuple(fold_changes(ch).first()) == ("x", 3, 7, None)
    c = spark.createDataFrame([("b", 1, "k1", "h"), ("b", 2, "k2", "h"), ("b", 3, "k3", "h")], "book_id string, revealed_at int, chapter_key string, content_hash string")
    r = spark.createDataFrame([("b", 1, "k1", "h"), ("b", 3, "k3", "h")], "book_id string, ordinal int, chapter_key string, content_hash string")
    assert ordering.frontier(c, r).first()["frontier"] == 1


def test_paths_and_holds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {(r.node, r.hops) for r in shortest_paths(e, "a").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    log = spark.createDataFrame([(1, "hold"), (2, "hold"), (1, "settle")], "hold_id int, op string")
    assert [r.hold_id for r in ledger.open_holds(log).collect()] == [2]


def test_planted_leak_is_caught(spark):
    facts = spark.createDataFrame([(w,) for w in ("garden", "letter", "walk")], "word string")
    names = spark.createDataFrame([("ivan",)], "word string")
    recaps = spark.createDataFrame([(1, "Ivan walks in the garden with a letter."), (2, "Ivan was murdered by strangers tonight.")], "recap_id int, text string")
    got = {r.recap_id: r.verdict for r in gates.ground(recaps, facts, names).collect()}
    assert got == {1: "ok", 2: "hard"}
    with pytest.raises(gates.LeakError):
        gates.assert_clean(gates.ground(recaps, facts, names))
