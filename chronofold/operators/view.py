"""As-of reads: the one door to the fact tables.

``Memory(tables).view(bookmark)`` gives lazy DataFrames of what a reader at that bookmark
may know: revealed by then, not retracted, still valid, and with every referenced entity,
event and chapter visible too. ``audit`` is the named, unfiltered bypass. Filters come
first in every plan, so they reach the scan; closures are left-semi joins, which Spark
broadcasts or shuffles by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALID_TIME = {"entities", "edges", "events", "themes", "states"}
FACTS = VALID_TIME | {"chapters", "raw", "summaries", "aliases", "participants", "chunks"}


def strict_bookmark(bookmark: object) -> int:
    """A chapter ordinal; anything but an int (a bool too) is refused before a plan exists."""
    if type(bookmark) is not int:
        raise ValueError(f"a bookmark is an int chapter ordinal, not {bookmark!r}")
    return bookmark


def bookmark_literal(value: Column) -> Column:
    """The bookmark that a JSON value writes; null for anything but a whole number: fractions, strings, truth values, nulls,
    numbers beyond a long."""
    return F.when(value.rlike(r"^-?(?:0|[1-9][0-9]{0,17})$"), value.try_cast("long"))


def effective_bookmark(requested: Column, stored: Column, *frontiers: Column) -> Column:
    """What a reader may see: the stored position held back by every frontier (the durable one, and for generated
    text the ingested one), lowered by what is asked for; null where less than 0 is asked for."""
    high_water = F.least(stored, *frontiers) if frontiers else stored
    return F.when(requested.isNull(), high_water).when(requested >= 0, F.least(requested, high_water))


def visible(df: DataFrame, bookmark: int | Column, book_id: str | None = None) -> DataFrame:
    """The mandatory predicate over whichever of its columns the table has."""
    at = F.lit(strict_bookmark(bookmark)) if not isinstance(bookmark, Column) else bookmark
    out = df.where(F.col("revealed_at") <= at)
    if "retracted_at" in df.columns:
        out = out.where(F.col("retracted_at").isNull())
    if "invalid_at" in df.columns:
        out = out.where(F.col("invalid_at").isNull() | (F.col("invalid_at") > at))
    return out if book_id is None else out.where(F.col("book_id") == book_id)


class Memory:
    def __init__(self, **tables: DataFrame):
        unknown = set(tables) - FACTS
        if unknown:
            raise ValueError(f"not guarded fact tables: {sorted(unknown)}")
        self._tables = tables

    def view(self, bookmark: int, book_id: str | None = None) -> BookmarkView:
        return BookmarkView(self._tables, strict_bookmark(bookmark), book_id)

    def audit(self, name: str) -> DataFrame:
        return self._tables[name]


class BookmarkView:
    def __init__(self, tables: dict[str, DataFrame], bookmark: int, book_id: str | None):
        self._tables, self.bookmark, self.book_id = tables, bookmark, book_id

    def rows(self, name: str) -> DataFrame:
        if name not in FACTS:
            raise ValueError(f"{name} is not a fact table")
        df = self._tables[name]
        return visible(df, self.bookmark, self.book_id if "book_id" in df.columns else None)

    def _ids(self) -> DataFrame:
        return self.rows("entities").select("entity_id")

    def chapters(self) -> DataFrame:
        return self.rows("chapters")

    def entities(self, type_: str | None = None) -> DataFrame:
        rows = self.rows("entities")
        return rows if type_ is None else rows.where(F.col("type") == type_)

    def timeline(self) -> DataFrame:
        return self.rows("events")

    def themes(self) -> DataFrame:
        return self.rows("themes")

    def aliases(self) -> DataFrame:
        return self.rows("aliases").join(self._ids(), "entity_id", "left_semi")

    def relationships(self) -> DataFrame:
        ids = self._ids()
        edges = self.rows("edges")
        return edges.join(ids, edges["src_entity"] == ids["entity_id"], "left_semi").join(
            ids, edges["dst_entity"] == ids["entity_id"], "left_semi"
        )

    def of_live_chapters(self, name: str) -> DataFrame:
        """Rows whose chapter is visible too: a mis-stamped row does not get through."""
        return self.rows(name).join(self.chapters().select("chapter_key"), "chapter_key", "left_semi")

    def participants(self) -> DataFrame:
        """Event, entity and role where event, link and entity are all visible."""
        links = self.rows("participants").join(self.timeline().select("event_id"), "event_id", "left_semi")
        return links.join(self.entities().select("entity_id", "canonical_name", "type"), "entity_id")

    def events_for(self) -> DataFrame:
        links = self.rows("participants").join(self._ids(), "entity_id", "left_semi")
        return links.select("entity_id", "event_id", "role").join(self.timeline(), "event_id")

    def latest_state(self) -> DataFrame:
        states = self.rows("states").join(self._ids(), "entity_id", "left_semi")
        newest = Window.partitionBy("entity_id").orderBy(F.desc("revealed_at"), F.desc("state_id"))
        return states.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")

    def catch_up(self) -> DataFrame:
        """One row: the latest rolling recap (its chapter need not be live), cast size, open threads."""
        recap = self.rows("summaries").where("kind = 'rolling-recap'")
        one = recap.agg(F.max_by("body", F.struct("revealed_at", "summary_id")).alias("recap"))
        cast = self.entities("character").agg(F.count(F.lit(1)).alias("cast_size"))
        open_ = self.relationships().agg(F.count(F.lit(1)).alias("open_threads"))
        return one.join(cast).join(open_)  # three one-row aggregates

    def ties(self) -> DataFrame:
        """Per entity and other entity the first visible edge between them, with the other's name."""
        edges = self.relationships()
        out = edges.select(F.col("src_entity").alias("entity_id"), F.col("dst_entity").alias("other_id"), "rel_type", "label", "revealed_at", "edge_id")
        back = edges.select(F.col("dst_entity").alias("entity_id"), F.col("src_entity").alias("other_id"), "rel_type", "label", "revealed_at", "edge_id")
        first = Window.partitionBy("entity_id", "other_id").orderBy("revealed_at", "edge_id")
        both = out.unionByName(back).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        names = self.entities().select(F.col("entity_id").alias("other_id"), F.col("canonical_name").alias("other_name"))
        return both.join(names, "other_id")

    def cast(self) -> DataFrame:
        """Distinct surface form to entity: canonical names before aliases, earlier entities first."""
        people = self.entities().select("entity_id", "canonical_name", "revealed_at")
        forms = people.select("entity_id", F.col("canonical_name").alias("form"), "revealed_at", F.lit(0).alias("rank"))
        more = self.aliases().select("entity_id", F.col("surface").alias("form")).join(people.select("entity_id", "revealed_at"), "entity_id")
        forms = forms.unionByName(more.select("entity_id", "form", "revealed_at", F.lit(1).alias("rank")))
        first = Window.partitionBy("form").orderBy("rank", "revealed_at", "entity_id")
        return forms.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("form", "entity_id")

    def graph(self) -> DataFrame:
        """Entities with their visible aliases, one row each."""
        named = self.aliases().groupBy("entity_id").agg(F.sort_array(F.collect_set("surface")).alias("aliases"))
        return self.entities().join(named, "entity_id", "left")

    def supplied_facts(self) -> DataFrame:
        """Everything a generator may be told, as (kind, text)."""
        parts = [
            self.entities().select(F.lit("name").alias("kind"), F.col("canonical_name").alias("text")),
            self.aliases().select(F.lit("alias").alias("kind"), F.col("surface").alias("text")),
            self.timeline().select(F.lit("event").alias("kind"), F.col("summary").alias("text")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()


EMPTY_ROSTER = "(none yet — this is the first chapter)"  # fixed value


def roster_text(roster: DataFrame, chapters: DataFrame, by: str = "revealed_at") -> DataFrame:
    """``by, roster``: the cast that each of ``chapters`` (``by``) brings in, a line each (name, type, other names), or the fixed empty text. ``roster``:
    ``by, entity_id, canonical_name, type, aliases``."""
    aka = F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (aka "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), "canonical_name", F.lit(" ["), "type", F.lit("]"), aka)
    lines = roster.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("entity_id", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return chapters.select(by).distinct().join(lines, by, "left").select(by, F.coalesce(text, F.lit(EMPTY_ROSTER)).alias("roster"))


def chapters_with(needle: str, chapters: DataFrame, *texts: DataFrame) -> DataFrame:
    """The ``chapters`` (``revealed_at, title``) that hold ``needle``, in any case, in their title or in one of ``texts`` (``revealed_at, text``: summaries, new
    names, events). A blank needle holds everywhere."""
    wanted = needle.strip().lower()
    all_ = reduce(DataFrame.unionByName, [chapters.select("revealed_at", F.col("title").alias("text")), *[t.select("revealed_at", "text") for t in texts]])
    hit = all_.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(wanted))).select("revealed_at").distinct()
    return chapters.join(hit, "revealed_at", "left_semi") if wanted else chapters
