"""Chapters' extractions into fact tables: all tables of a batch first, its receipts last.

A batch writes one folder per table, which it overwrites when it runs again; what has no receipt is not read. So a batch that
breaks off anywhere leaves nothing that is seen, and running it again gives what running it once gives.

``extractions``: ``book_id, chapter_key, ordinal, title, text, summary, entities`` (array of ``name, type, aliases, state``),
``relationships`` (``src, dst, rel_type, label``), ``events`` (``summary, participants``), ``themes`` (``name, description``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import text as X
from chronofold.sources.shared import settled

CHUNK = 500
CHAPTER = ("book_id", "chapter_key", "ordinal")


def outcomes(extractions: DataFrame, receipts: DataFrame) -> DataFrame:
    """``extractions`` with ``content_hash`` and ``outcome``: ``append``, ``no-op`` (the same content has a receipt) or ``changed`` (other
    content has one: refused, as nothing is rewritten). ``receipts``: ``book_id, chapter_key, content_hash``."""
    done = receipts.groupBy("book_id", "chapter_key").agg(F.collect_set("content_hash").alias("_had"))
    rows = extractions.withColumn("content_hash", X.content_hash(F.coalesce("text", F.lit("")))).join(done, ["book_id", "chapter_key"], "left")
    same = F.array_contains("_had", F.col("content_hash"))
    return rows.withColumn("outcome", F.when(F.col("_had").isNull(), "append").when(same, "no-op").otherwise("changed")).drop("_had")


def _each(rows: DataFrame, column: str, as_: str) -> DataFrame:
    return rows.select(*CHAPTER, F.posexplode(column).alias("pos", as_))


def _key(name: Column) -> Column:
    return X.normalise_fast(name)


def facts(chapters: DataFrame, roster: DataFrame) -> dict[str, DataFrame]:
    """The tables that ``chapters`` (extractions that are to be appended) make. ``roster``: ``book_id, entity_id, name, is_alias`` of what is known.

    A name is the known identity that bears it as its name, else as an alias, else a new one, made once a book at its
    first chapter. A mention's other names become its aliases unless they are taken. Of an identity's states in a
    chapter the last one counts. References to names that nobody bears by then are left out and counted (``unresolved``).
    """
    mentions = _each(chapters, "entities", "e").select(*CHAPTER, "pos", "e.*").withColumn("key", _key(F.col("name"))).where(F.col("key") != "")
    known = roster.select("book_id", _key(F.col("name")).alias("key"), "entity_id", F.col("is_alias").cast("int").alias("rank"))
    of_key = known.groupBy("book_id", "key").agg(F.min(F.struct("rank", "entity_id")).alias("k")).select("book_id", "key", F.col("k.entity_id").alias("known_id"))
    fresh = F.concat(F.lit("e"), F.hex(F.xxhash64("book_id", "key")))
    mentions = settled(mentions.join(of_key, ["book_id", "key"], "left").withColumn("entity_id", F.coalesce("known_id", fresh)))

    first = mentions.where("known_id is null").groupBy("book_id", "entity_id").agg(F.min(F.struct("ordinal", "pos", "chapter_key", "name", "type")).alias("f"))
    entities = first.select("book_id", "f.chapter_key", F.col("f.ordinal").alias("ordinal"), "entity_id", F.col("f.name").alias("canonical_name"), "f.type")
    also = mentions.select(*CHAPTER, "entity_id", F.explode("aliases").alias("surface")).withColumn("key", _key(F.col("surface"))).where(F.col("key") != "")
    own = mentions.select("book_id", "key").distinct()
    also = also.join(of_key, ["book_id", "key"], "left_anti").join(own, ["book_id", "key"], "left_anti")
    also = also.groupBy("book_id", "key").agg(F.min(F.struct("ordinal", "chapter_key", "entity_id", "surface")).alias("a"))  # who bears it first
    aliases = also.select("book_id", "a.chapter_key", F.col("a.ordinal").alias("ordinal"), "a.entity_id", "a.surface")

    said = mentions.where("state is not null").groupBy(*CHAPTER, "entity_id").agg(F.max_by("state", "pos").alias("status"))
    # A key is one identity's; a chapter may refer to it from the chapter on that tells it.
    names = of_key.select("book_id", "key", F.col("known_id").alias("entity_id"), F.lit(None).cast("int").alias("since"))
    names = names.unionByName(mentions.where("known_id is null").select("book_id", "key", "entity_id", F.col("ordinal").alias("since")))
    names = names.unionByName(aliases.select("book_id", _key(F.col("surface")).alias("key"), "entity_id", F.col("ordinal").alias("since")))
    bearer = settled(names.groupBy("book_id", "key").agg(F.first("entity_id").alias("who"), F.min("since").alias("since")))

    def led(df: DataFrame, column: str, to: str) -> DataFrame:
        rows = df.withColumn("key", _key(F.col(column))).join(bearer, ["book_id", "key"], "left")
        return rows.withColumn(to, F.when(F.col("since").isNull() | (F.col("since") <= F.col("ordinal")), F.col("who"))).drop("key", "who", "since")


    told = led(led(_each(chapters, "relationships", "r").select(*CHAPTER, "pos", "r.*"), "src", "src_entity"), "dst", "dst_entity")
    events = _each(chapters, "events", "v").select(*CHAPTER, (F.col("pos") + 1).alias("order_idx"), "v.*")
    played = led(events.select(*CHAPTER, "order_idx", F.explode("participants").alias("name")), "name", "entity_id")
    lost = told.where("src_entity is null or dst_entity is null").select(*CHAPTER).unionByName(played.where("entity_id is null").select(*CHAPTER))
    text = F.coalesce("text", F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / CHUNK) - 1, F.lit(0)).cast("int"))
    chunks = chapters.where(F.length(text) > 0).select(*CHAPTER, F.explode(starts).alias("part"), text.alias("_t"))
    return {
        "chapters": chapters.select(*CHAPTER, "title", "content_hash"),
        "raw": chapters.where(F.length(text) > 0).select(*CHAPTER, "text"),
        "summaries": chapters.select(*CHAPTER, "summary"),
        "entities": entities,
        "aliases": aliases,
        "states": said,
        "edges": told.where("src_entity is not null and dst_entity is not null").select(*CHAPTER, "pos", "src_entity", "dst_entity", "rel_type", "label"),
        "events": events.select(*CHAPTER, "order_idx", "summary"),
        "participants": played.where("entity_id is not null").select(*CHAPTER, "order_idx", "entity_id").distinct(),
        "themes": _each(chapters, "themes", "t").select(*CHAPTER, "t.name", "t.description"),
        "chunks": chunks.select(*CHAPTER, "part", F.substring("_t", F.col("part") * CHUNK + 1, F.lit(CHUNK)).alias("text")),
        "unresolved": lost.groupBy(*CHAPTER).agg(F.count(F.lit(1)).alias("n")),
    }


RECEIPT = "book_id string, chapter_key string, content_hash string, batch string"


def receipts(spark: SparkSession, root: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/receipts")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], RECEIPT)
    return spark.read.schema(RECEIPT).parquet(f"{root}/receipts")


def write_chapters(extractions: DataFrame, roster: DataFrame, root: str, batch: str, after: Callable[[str], None] = lambda step: None) -> DataFrame:
    """Writes a batch below ``root`` and returns ``book_id, chapter_key, outcome`` of its chapters. Chapters that a receipt shows are left
    alone; repeated rows of a chapter are one, of different contents in one batch the least hash counts and the others
    are ``changed``. ``after`` is told each step."""
    spark = extractions.sparkSession
    rows = outcomes(extractions, receipts(spark, root).where(F.col("batch") != batch))
    place = F.row_number().over(Window.partitionBy("book_id", "chapter_key").orderBy("content_hash"))
    rows = rows.withColumn("_n", place).withColumn("_first", F.first("content_hash").over(Window.partitionBy("book_id", "chapter_key").orderBy("content_hash")))
    rows = settled(rows.withColumn("outcome", F.when((F.col("outcome") == "append") & (F.col("content_hash") != F.col("_first")), "changed").otherwise(F.col("outcome"))))
    new = rows.where("outcome = 'append' and _n = 1").drop("_n", "_first")
    for name, table in facts(new, roster).items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        after(name)
    done = new.select("book_id", "chapter_key", "content_hash", F.lit(batch).alias("batch"))
    done.write.mode("overwrite").parquet(f"{root}/receipts/of={batch}")  # last: from here on the batch is read
    after("receipts")
    return rows.select("book_id", "chapter_key", "outcome").distinct()


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's rows of the batches that have receipts."""
    done = receipts(spark, root).select("batch").distinct()
    rows = spark.read.option("basePath", f"{root}/{table}").option("inferSchema", False).parquet(f"{root}/{table}")
    return rows.withColumn("batch", F.col("batch").cast("string")).join(done, "batch", "left_semi").drop("batch")
