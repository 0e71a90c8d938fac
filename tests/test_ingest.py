"""Chapters into tables: what is not receipted is not read, references do not reach ahead, changed contents are refused."""

import pytest

from chronofold.operators import ingest as I

SHAPE = (
    "book_id string, chapter_key string, ordinal int, title string, text string, summary string, entities array<struct<name:string,type:string,aliases:array<string>,state:string>>, "
    "relationships array<struct<src:string,dst:string,rel_type:string,label:string>>, events array<struct<summary:string,participants:array<string>>>, themes array<struct<name:string,description:string>>"
)
ROWS = [
    ("b", "k1", 1, "One", "x" * 1_100, "s1", [("Ivan", "person", ["Vanya"], "calm"), ("IVAN", "person", [], "angry"), ("Ana", "person", None, None)], [("Ivan", "Ana", "knows", "l"), ("Ivan", "Zossima", "visits", "l")], [("e1", ["Ivan", "vanya", "Nobody"]), ("e2", None)], [("Guilt", None)]),
    ("b", "k2", 2, "Two", "", None, [("Zossima", "monk", ["Elder", "Ivan"], "old"), ("Old Known", "person", [], "s")], [("Elder", "Vanya", "loves", "l")], [("e3", ["Zossima"])], []),
    ("b", "k3", 3, "Three", None, "s3", None, None, None, None),
]
KNOWN = [("b", "id9", "Known", False), ("b", "id9", "Old Known", True), ("c", "idc", "Ivan", False)]


class Stop(Exception):
    pass


def tables(spark, root):
    names = ["chapters", "raw", "summaries", "entities", "aliases", "states", "edges", "events", "participants", "themes", "chunks", "unresolved"]
    return {n: sorted(map(str, (tuple(r) for r in I.read(spark, root, n).collect()))) for n in names}


@pytest.fixture
def given(spark):
    return spark.createDataFrame(ROWS, SHAPE), spark.createDataFrame(KNOWN, "book_id string, entity_id string, name string, is_alias boolean")


def test_facts_of_chapters(spark, given, tmp_path):
    root = str(tmp_path / "facts")
    got = {r.chapter_key: r.outcome for r in I.write_chapters(*given, root, "b1").collect()}
    assert got == {"k1": "append", "k2": "append", "k3": "append"}
    of = {r.canonical_name: r for r in I.read(spark, root, "entities").collect()}
    assert {n: (r.ordinal, r.type) for n, r in of.items()} == {"Ivan": (1, "person"), "Ana": (1, "person"), "Zossima": (2, "monk")}
    name = {r.entity_id: n for n, r in of.items()} | {"id9": "Known"}
    assert {(name[r.entity_id], r.surface, r.ordinal) for r in I.read(spark, root, "aliases").collect()} == {("Ivan", "Vanya", 1), ("Zossima", "Elder", 2)}
    assert {(r.ordinal, name[r.entity_id], r.status) for r in I.read(spark, root, "states").collect()} == {(1, "Ivan", "angry"), (2, "Zossima", "old"), (2, "Known", "s")}
    # Zossima is not known yet in the first chapter, so that relation stays out.
    assert {(r.ordinal, name[r.src_entity], name[r.dst_entity]) for r in I.read(spark, root, "edges").collect()} == {(1, "Ivan", "Ana"), (2, "Zossima", "Ivan")}
    assert {(r.ordinal, r.order_idx, name[r.entity_id]) for r in I.read(spark, root, "participants").collect()} == {(1, 1, "Ivan"), (2, 1, "Zossima")}
    assert {(r.ordinal, r.n) for r in I.read(spark, root, "unresolved").collect()} == {(1, 2)}
    assert sorted((r.part, len(r.text)) for r in I.read(spark, root, "chunks").collect()) == [(0, 500), (1, 500), (2, 100)]
    assert I.read(spark, root, "raw").count() == 1 and I.read(spark, root, "chapters").count() == 3


@pytest.mark.parametrize("step", ["chapters", "edges", "unresolved"])
def test_a_batch_that_breaks_off_is_not_read_and_runs_again(spark, given, tmp_path, step):
    def stop(found):
        if found == step:
            raise Stop(step)

    root, clean = str(tmp_path / "facts"), str(tmp_path / "clean")
    with pytest.raises(Stop):
        I.write_chapters(*given, root, "b1", stop)
    assert I.read(spark, root, "chapters").count() == 0 and I.receipts(spark, root).count() == 0
    I.write_chapters(*given, root, "b1")
    I.write_chapters(*given, clean, "b1")
    once = tables(spark, root)
    assert once == tables(spark, clean)
    I.write_chapters(*given, root, "b1")  # a batch that ends and runs again gives the same
    assert tables(spark, root) == once


def test_receipted_chapters_are_left_alone_and_changed_ones_refused(spark, given, tmp_path):
    root = str(tmp_path / "facts")
    rows, roster = given
    I.write_chapters(rows, roster, root, "b1")
    before = tables(spark, root)
    other = [list(r) for r in ROWS]
    other[0][4] = "other text"
    more = [*map(tuple, other), ("b", "k4", 4, "Four", "t", "s", [], [], [], []), ("b", "k4", 4, "Four", "t", "s", [], [], [], []), ("b", "k4", 4, "Four", "u", "s", [], [], [], [])]
    got = sorted((r.chapter_key, r.outcome) for r in I.write_chapters(spark.createDataFrame(more, SHAPE), roster, root, "b2").collect())
    assert got == [("k1", "changed"), ("k2", "no-op"), ("k3", "no-op"), ("k4", "append"), ("k4", "changed")]
    after = tables(spark, root)
    assert set(before["raw"]) <= set(after["raw"]) and len(after["chapters"]) == 4 and before["entities"] == after["entities"]
