"""Helpers that several operators share: shared storage, word splitting, folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word of the decontamination contract: no ASCII control, punctuation, space or capital.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same set of characters as Java's matcher finds it fastest; with capitals, to count words in any case.
JVM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
JVM_WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests on one machine) a folder of our own is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return str(jdir.get())
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        found = tempfile.mkdtemp(prefix="chronofold-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back (columnar, so later reads prune)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/chronofold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The contract's words of a text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(
        F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(JVM_WORD), F.lit(0)
    )


def n_words(text: Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(JVM_WORD_ANY_CASE)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier's text, modulo five; fold 0 is never learnt from."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))
