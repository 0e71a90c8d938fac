import io
import zipfile

import pytest
from pyspark.sql import functions as F

from chronofold.functions.text import split_bytes
from chronofold.sources import archive as A
from chronofold.sources import epub
from chronofold.streaming import position


def test_book_round_trip_and_bounds(spark):
    good = epub.write([("c1.xhtml", "One", "One & only", "It began."), ("c2.xhtml", "Two", "Two", "It <ended>.")])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb", b"\0" * (4 << 20))
    files = spark.createDataFrame([("g", bytearray(good)), ("bomb", bytearray(buffer.getvalue())), ("cut", bytearray(b"x"))], "path string, content binary")
    got = {(r.path, r.position): r for r in epub.read(files).collect()}
    assert got["g", 1].heading == "One & only" and got["g", 2].text.endswith("It <ended>.") and got["g", 2].label == "Two"
    assert got["bomb", 0].error == "member too large" and got["cut", 0].error


def test_hostile_books_are_error_rows(spark):
    good = epub.write([("c.xhtml", "One", "One", "x")])
    entity = epub.write([("c.xhtml", "One", "One", "x")], more={"META-INF/encryption.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a/>'})
    many = epub.write([("c.xhtml", "One", "One", "x")], more={f"m{i}": "" for i in range(5000)})
    wrong = epub.write([("c.xhtml", "One", "One", "x")], more={"mimetype": "text/plain"})
    same = epub.write([("c.xhtml", "One", "One", "x")], more={"OPS/C.xhtml": "y"})
    broken = bytearray(good)
    broken[good.index(b"META-INF/container.xml") + 24] ^= 255  # inside a packed member
    files = {"entity": entity, "many": many, "wrong": wrong, "same": same, "broken": bytes(broken), "more": good + b"x", "good": good}
    got = {r.path: r.error for r in epub.read(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")).collect()}
    assert got["good"] is None and (got["entity"], got["many"], got["wrong"], got["same"], got["more"]) == (
        "entity declarations", "too large", "wrong mimetype", "names collide", "no end record",
    )
    assert got["broken"]


@pytest.mark.parametrize("text,limit", [("", 5), ("abc def ghi", 5), ("äöü" * 9, 5), ("one\n\ntwo three", 8)])
def test_split_is_lossless(text, limit):
    parts = split_bytes(text, limit)
    assert "".join(parts) == text and all(len(p.encode()) <= limit for p in parts)


def test_null_positions_change_nothing(spark, tmp_path):
    rows = [(1, 1, 7, "click", 0.0, '{"k": 4}'), (2, 2, 7, "click", 0.0, None), (3, 3, 7, "view", 0.0, "{}"), (4, 4, 8, "view", 0.0, None)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = position.reports(spark, str(tmp_path / "in"), "*.parquet")
    out = position.run_once(position.high_water(stream), str(tmp_path / "c")).groupBy("book_id").agg(F.max("bookmark").alias("b"))
    assert {r.book_id: r.b for r in out.collect()} == {7: 4, 8: 0}


class Stop(Exception):
    pass


def stop_after(step):
    def told(found):
        if found == step:
            raise Stop(step)

    return told


def two(spark, n):
    return {"a": spark.range(n).selectExpr("id AS book_id", "id * 2 AS v"), "b": spark.range(n).selectExpr("id AS book_id")}


@pytest.mark.parametrize("step", ["verified", "table a", "table b", "inventory", None])
def test_a_restore_that_breaks_off_leaves_the_old_version(spark, tmp_path, step):
    archive, target = str(tmp_path / "archive"), str(tmp_path / "target")
    new = A.backup(two(spark, 5), archive)
    old = A.backup(two(spark, 2), target)
    with pytest.raises(A.ArchiveError, match="holds a version"):
        A.restore(spark, archive, target)
    if step:
        with pytest.raises(Stop):
            A.restore(spark, archive, target, replace=True, after=stop_after(step))
        assert A.read(spark, target, "a").count() == 2 and A.read(spark, target, "b").count() == 2
    A.restore(spark, archive, target, replace=True)
    assert A.read(spark, target, "a").agg({"v": "sum"}).first()[0] == 20
    A.roll_back(spark, target, old)
    assert A.read(spark, target, "a").count() == 2
    assert A.current(spark, archive).endswith(new)


@pytest.mark.parametrize("step", ["table a", "inventory"])
def test_a_backup_that_breaks_off_is_not_seen(spark, tmp_path, step):
    root = str(tmp_path / "archive")
    with pytest.raises(Stop):
        A.backup(two(spark, 3), root, after=stop_after(step))
    assert A.current(spark, root) is None
    A.backup(two(spark, 4), root)
    with pytest.raises(Stop):
        A.backup(two(spark, 9), root, after=stop_after(step))
    assert A.read(spark, root, "a").count() == 4


def test_backups_are_of_books_without_open_reservations(spark, tmp_path):
    root, holds = str(tmp_path / "x"), spark.createDataFrame([(2,)], "book_id long")
    books = lambda *ids: spark.createDataFrame([(i,) for i in ids], "book_id long")
    with pytest.raises(A.ArchiveError, match="reservation"):
        A.backup(two(spark, 5), root, books=books(1, 2), holds=holds)
    with pytest.raises(A.ArchiveError, match="reservation"):
        A.backup(two(spark, 5), root, holds=holds)
    A.backup(two(spark, 5), root, books=books(1, 3), holds=holds)
    assert sorted(r.book_id for r in A.read(spark, root, "b").collect()) == [1, 3]
    with pytest.raises(A.ArchiveError, match="would be lost"):
        A.restore(spark, root, str(tmp_path / "y"), keep=books(1, 4))
    A.restore(spark, root, str(tmp_path / "y"), keep=books(1))


def test_a_changed_file_is_refused(spark, tmp_path):
    root = str(tmp_path / "x")
    version = A.backup(two(spark, 5), root)
    part = next((tmp_path / "x" / "versions" / version / "a").glob("*.parquet"))
    spark.range(3).selectExpr("id AS book_id", "id AS v").coalesce(1).write.parquet(str(tmp_path / "other"))
    part.write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(A.ArchiveError, match="not those"):
        A.restore(spark, root, str(tmp_path / "y"))
    with pytest.raises(A.ArchiveError, match="nothing"):
        A.restore(spark, str(tmp_path / "none"), str(tmp_path / "y"))


def test_retention_skips_books_that_are_not_due(spark):
    rows = [(1, i, f"2024-01-0{i} 00:00:00") for i in range(1, 6)] + [(2, 10 + i, f"2024-01-0{i} 00:00:00") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "book_id int, archive_id int, t string").withColumn("at", F.col("t").cast("timestamp"))
    got = A.surplus(df, 3, F.lit("2024-01-08 06:00:00").cast("timestamp"), 24)
    assert sorted(r.archive_id for r in got.collect()) == [1, 2]


def test_stream_equals_batch(spark, sf, tmp_path):
    from chronofold.plans import registry

    registry.load()
    out = position.run_once(position.high_water(position.reports(spark, sf)), str(tmp_path / "c"))
    last = {r.book_id: (r.s.epoch, r.s.bookmark) for r in out.groupBy("book_id").agg(F.max(F.struct("epoch", "bookmark")).alias("s")).collect()}
    batch = {}
    for r in registry.QUERIES["st_reset_epoch"](spark, sf).collect():
        batch[r.book_id] = max(batch.get(r.book_id, (-1, 0)), (r.epoch, r.bookmark))
    assert last == batch


def test_ingest_writes_receipts_last(spark, sf, tmp_path):
    q = position.ingest(position.reports(spark, sf), str(tmp_path / "f"), str(tmp_path / "r"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_a_table_is_written_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "FILE_ROWS", 2)
    A.backup({"t": spark.range(5).coalesce(1)}, str(tmp_path / "a"))
    folder = A.current(spark, str(tmp_path / "a"))
    assert A.digests(spark, folder).count() == 3 and spark.read.json(f"{folder}/inventory").count() == 3
    assert A.read(spark, str(tmp_path / "a"), "t").count() == 5
