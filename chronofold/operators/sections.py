"""Which atom of a book a section of its reader's spine is: exact paths first, then suffixes, and no guesses.

Both directions of "one path ends with the other" are lookups in an index of suffixes, which holds one row per
book and suffix: its first atom and whether all that have it are one file. So no pairs are formed,
however many paths share a last piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import text as X


def suffixes(path: Column) -> Column:
    """The path's proper suffixes: what is left after one leading piece, two, and so on."""
    pieces = F.split(path, "/")
    cuts = F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2)))
    ends = F.transform(cuts, lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))
    return F.filter(ends, lambda s: s != "")


def _first(atoms: DataFrame, key: str) -> DataFrame:
    return atoms.groupBy("book", key).agg(F.min("atom").alias("atom"), F.min("a_href").alias("low"), F.max("a_href").alias("high"))


def section_atoms(sections: DataFrame, atoms: DataFrame) -> DataFrame:
    """``book, section, atom`` (null: none) for ``sections`` (``book, section, href``) over ``atoms`` (``book, atom,
    href``; ``atom`` is a number in reading order).

    An equal path wins and takes the first atom of its file; what is taken so is closed to suffixes. A suffix
    counts when all its candidates are one file, and takes its first atom. Two sections that claim one atom by
    suffix both lose it.
    """
    sections = sections.select("book", "section", X.href_norm(F.col("href")).alias("s_href"))
    atoms = atoms.select("book", "atom", X.href_norm(F.col("href")).alias("a_href")).where(F.col("a_href") != "")
    by_path = _first(atoms, "a_href").select("book", F.col("a_href").alias("s_href"), F.col("atom").alias("exact"))
    rows = sections.join(by_path, ["book", "s_href"], "left")
    taken = rows.where("exact is not null").select("book", F.col("exact").alias("atom")).distinct()

    open_ = rows.where((F.col("exact").isNull()) & (F.coalesce("s_href", F.lit("")) != "")).select("book", "section", "s_href")
    ends = _first(atoms.withColumn("s_href", F.explode(suffixes(F.col("a_href")))), "s_href")  # atoms that end with the section's path
    longer = open_.join(ends, ["book", "s_href"])
    shorter = open_.withColumn("end", F.explode(suffixes(F.col("s_href"))))  # and atoms whose path ends the section's
    shorter = shorter.join(_first(atoms.withColumn("end", F.col("a_href")), "end"), ["book", "end"])
    columns = ["book", "section", "atom", "low", "high"]
    found = longer.select(*columns).unionByName(shorter.select(*columns)).groupBy("book", "section")
    found = found.agg(F.min("atom").alias("atom"), F.min("low").alias("low"), F.max("high").alias("high")).where("low = high")
    found = found.join(taken, ["book", "atom"], "left_anti")
    sole = found.groupBy("book", "atom").agg(F.min("section").alias("section"), F.count(F.lit(1)).alias("n")).where("n = 1")
    claims = sole.select("book", "section", F.col("atom").alias("claimed"))
    return rows.join(claims, ["book", "section"], "left").select("book", "section", F.coalesce("exact", "claimed").alias("atom"))
