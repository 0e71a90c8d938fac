"""Manifests, portable exports and backups as JSON and Parquet."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def manifest(chapters: DataFrame) -> DataFrame:
    """Per book its atoms as one JSON document with a self-hash."""
    atom = F.struct("revealed_at", "chapter_key", "char_len")
    line = F.concat_ws(":", F.col("revealed_at").cast("string"), "chapter_key", F.col("char_len").cast("string"))
    atoms = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(atom)).alias("atoms"), F.array_sort(F.collect_list(F.struct("revealed_at", line.alias("l")))).alias("lines"))
    digest = F.substring(F.sha2(F.array_join(F.transform("lines", lambda x: x["l"]), "|"), 256), 1, 16)
    return atoms.select("book_id", F.to_json(F.struct("atoms")).alias("manifest"), digest.alias("hash"))


def read_manifest(manifests: DataFrame) -> DataFrame:
    """Atoms again, ``book_id, revealed_at, chapter_key, char_len``, of the books whose hash and run of ordinals hold; ``refused_manifests`` has the others."""
    return _parsed(manifests).where("ok").select("book_id", F.inline("m.atoms"))


def refused_manifests(manifests: DataFrame) -> DataFrame:
    """``book_id`` of the manifests that are not what they say."""
    return _parsed(manifests).where("not ok").select("book_id")


def _parsed(manifests: DataFrame) -> DataFrame:
    parsed = manifests.withColumn("m", F.from_json("manifest", "atoms array<struct<revealed_at:int,chapter_key:string,char_len:bigint>>"))
    line = F.transform("m.atoms", lambda a: F.concat_ws(":", a["revealed_at"].cast("string"), a["chapter_key"], a["char_len"].cast("string")))
    whole = F.forall(F.transform("m.atoms", lambda a, i: a["revealed_at"] == i + 1), lambda x: x)
    ok = (F.substring(F.sha2(F.array_join(line, "|"), 256), 1, 16) == F.col("hash")) & whole
    return parsed.select("book_id", F.coalesce(ok, F.lit(False)).alias("ok"), "m")


def export_rows(df: DataFrame, key: str) -> DataFrame:
    """Each row as a JSON array of its columns, binary ones in base64."""
    values = [F.base64(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    return df.select(F.col(key), F.to_json(F.struct(*[v.alias(c) for v, (c, _) in zip(values, df.dtypes)])).alias("row"))


def records(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of objects as rows with the object's fields; other fields are left out, an empty or null array has no row."""
    return rows.withColumn("_r", F.explode(F.from_json(column, f"array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in schema.split(', '))}>>"))).select("*", "_r.*").drop("_r", column)


FORMAT, VERSION = "portable-story", 6  # fixed values: what an export says of itself


def export_bundle(tables: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows of several tables (each with its key) as ``name, row``, and the manifest ``format, version, name, rows, size, digest``
    that binds them: how many rows, how many bytes, and an order-free digest."""
    each = [export_rows(df, key).select(F.lit(name).alias("name"), "row") for name, (df, key) in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b), each)
    return rows, _bound(rows).select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), "name", "rows", "size", "digest")


def _bound(rows: DataFrame) -> DataFrame:
    part = lambda at: F.sum(F.conv(F.substring(F.sha2("row", 256), at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("row")).alias("size"), F.concat_ws("-", part(1), part(16)).alias("digest"))


def import_bundle(rows: DataFrame, manifest: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle whose manifest holds. Refused: another format or version, other tables than ``schemas``, rows that
    the manifest does not bind."""
    if manifest.where(~(F.col("format").eqNullSafe(F.lit(FORMAT)) & F.col("version").eqNullSafe(F.lit(VERSION)))).limit(1).count():
        raise ArchiveError("another format or version")
    if sorted(r["name"] for r in manifest.select("name").collect()) != sorted(schemas):  # a row per table
        raise ArchiveError("other tables than the version has")
    found = _bound(rows).select("name", F.struct("rows", "size", "digest").alias("found"))
    said = manifest.select("name", F.struct("rows", "size", "digest").alias("said"))
    if said.join(found, "name", "full").where(~F.col("said").eqNullSafe(F.col("found"))).where("not (found is null and said.rows = 0)").limit(1).count():
        raise ArchiveError("the rows are not those of the manifest")
    return {n: import_rows(rows.where(F.col("name") == n), s) for n, s in schemas.items()}


def import_rows(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("row", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


class ArchiveError(RuntimeError):
    """A backup or restore that was refused; what was there before still is."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that ``root``'s marker names; None before anything was published."""
    marker, fs = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(marker):
        return None
    return f"{root}/versions/{spark.read.text(f'{root}/CURRENT').first()['value']}"


def publish(spark: SparkSession, root: str, version: str) -> None:
    """One marker names the version that is read; it is written beside and renamed over the old one, which is the
    only step that changes what readers see."""
    beside, fs = _fs(spark, f"{root}/.CURRENT-{version}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, renames)


FILE_ROWS = 100_000  # a file is read whole for its digest


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``name, found``: the SHA-256 of each data file below a version's folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    return files.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"), F.sha2("content", 256).alias("found"))


def _stage(spark: SparkSession, root: str, tables: dict[str, DataFrame], after) -> str:
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    for name, rows in tables.items():
        rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/{name}")
        after(f"table {name}")
    inventory = digests(spark, folder).withColumnRenamed("found", "sha256")
    # JSON, so that it is no data file itself; a row a file is shuffled, as one task would read all files otherwise.
    inventory.repartition(1).write.json(f"{folder}/inventory")
    after("inventory")
    return version


def verified(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a version whose files are all as its inventory says; raises otherwise."""
    inventory, fs = _fs(spark, f"{folder}/inventory/_SUCCESS")
    if not fs.exists(inventory):
        raise ArchiveError("no inventory")
    listed = spark.read.schema("name string, sha256 string").json(f"{folder}/inventory")
    if listed.join(digests(spark, folder), "name", "full").where(~F.col("sha256").eqNullSafe(F.col("found"))).limit(1).count():
        raise ArchiveError("the files are not those of the inventory")
    return [r["t"] for r in listed.select(F.split("name", "/")[0].alias("t")).distinct().orderBy("t").collect()]  # a few tables


def backup(tables: dict[str, DataFrame], root: str, *, books: DataFrame | None = None, holds: DataFrame | None = None, after=lambda step: None) -> str:
    """Writes a new version of ``tables`` (of ``books``' rows by ``book_id``, or of all) with its inventory, verifies it and publishes it. Refused
    while one of the books has an open reservation (``holds``: ``book_id``). ``after`` is told each step."""
    spark = next(iter(tables.values())).sparkSession
    if holds is not None:
        open_ = holds.select("book_id") if books is None else holds.join(books.select("book_id"), "book_id", "left_semi")
        if open_.limit(1).count():
            raise ArchiveError("a book has an open reservation")
    if books is not None:
        tables = {n: t.join(books.select("book_id").distinct(), "book_id", "left_semi") for n, t in tables.items()}
    version = _stage(spark, root, tables, after)
    verified(spark, f"{root}/versions/{version}")
    publish(spark, root, version)
    after("published")
    return version


def restore(spark: SparkSession, archive: str, target: str, *, replace: bool = False, keep: DataFrame | None = None, after=lambda step: None) -> str:
    """The archive's current version as the target's: verified, copied beside what is there, verified again and published by the marker, so
    that a failure at any step leaves the old version readable. A target that holds something is refused without
    ``replace``, and one with books beyond the archive's (``keep``: ``book_id`` of those it holds) always."""
    folder = current(spark, archive)
    if folder is None:
        raise ArchiveError("nothing was published there")
    names = verified(spark, folder)
    after("verified")
    if current(spark, target) is not None and not replace:
        raise ArchiveError("the target holds a version")
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    if keep is not None:
        of = [t.select(F.col("book_id").cast("string").alias("book_id")) for t in tables.values() if "book_id" in t.columns]
        if of and keep.select(F.col("book_id").cast("string").alias("book_id")).join(reduce(DataFrame.union, of), "book_id", "left_anti").limit(1).count():
            raise ArchiveError("other books would be lost")
    version = _stage(spark, target, tables, after)
    verified(spark, f"{target}/versions/{version}")
    publish(spark, target, version)
    after("published")
    return version


def roll_back(spark: SparkSession, root: str, version: str) -> None:
    """Makes an earlier version the current one again, if it is whole."""
    verified(spark, f"{root}/versions/{version}")
    publish(spark, root, version)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    folder = current(spark, root)
    if folder is None:
        raise ArchiveError("nothing was published there")
    return spark.read.parquet(f"{folder}/{table}")


def surplus(archives: DataFrame, keep: int, now, hours: float) -> DataFrame:
    """``archives`` (``book_id, archive_id, at``) that a retention run removes: all but each book's ``keep`` newest. A book whose newest is
    younger than ``hours`` is skipped: no backup of it was due, so nothing is removed."""
    w = Window.partitionBy("book_id")
    rows = archives.withColumn("n", F.row_number().over(w.orderBy(F.desc("at"), F.desc("archive_id")))).withColumn("newest", F.max("at").over(w))
    due = F.unix_timestamp("newest") <= F.unix_timestamp(now) - hours * 3_600
    return rows.where(due & (F.col("n") > keep)).drop("n", "newest")
