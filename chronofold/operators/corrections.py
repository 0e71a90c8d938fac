"""Corrections of identities as of a point in the story: replacements and merges that carry all dependents, splits
with complete maps, and guarded names.

Rows are live at ``at`` when they were revealed before it, have not ended by it and are
not retracted. A correction ends the source at ``at`` and gives what hangs on it to new
identities from there on, so that earlier bookmarks read what they always read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.sources.shared import settled

def live(at: int) -> Column:
    return F.col("retracted_at").isNull() & (F.col("revealed_at") < at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))


def _one(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _complete(what: str, ids: DataFrame, given: DataFrame, parts: DataFrame) -> None:
    """Each of ``ids`` (``id``) has one part or more, and ``given`` (``id, part_id``) names nothing else."""
    if _one(ids.join(given, "id", "left_anti")):
        raise ValueError(f"{what}: a dependent has no part")
    if _one(given.join(ids, "id", "left_anti")) or _one(given.join(parts, "part_id", "left_anti")):
        raise ValueError(f"{what}: an unknown dependent or part is named")


def split(entities: DataFrame, aliases: DataFrame, edges: DataFrame, participants: DataFrame, *, entity_id: str, at: int, parts: DataFrame, alias_map: DataFrame, edge_map: DataFrame, event_map: DataFrame) -> DataFrame:
    """What a split makes: ``kind, id, owner, other`` with kinds ``entity`` (the parts), ``alias``, ``edge`` (one
    row per end that moves) and ``event``. The source ends at ``at``.

    ``parts``: ``part_id, canonical_name, type``; the maps: ``id, part_id``, complete for all that is live and
    hangs on the source. Refused: fewer than two parts, another type, a source that is not live, gaps or
    strangers in a map, an edge of the source to itself.
    """
    source = entities.where((F.col("entity_id") == entity_id) & live(at)).select("type").limit(2).collect()
    if len(source) != 1:
        raise ValueError("the source is not live")
    if parts.limit(2).count() < 2 or _one(parts.where(~F.col("type").eqNullSafe(source[0]["type"]) | (F.trim("canonical_name") == "") | F.col("canonical_name").isNull())):
        raise ValueError("a split needs two named parts or more of the source's type")
    # What hangs on one identity is small and read several times.
    mine = settled(edges.where(live(at) & ((F.col("src_entity") == entity_id) | (F.col("dst_entity") == entity_id))))
    if _one(mine.where("src_entity = dst_entity")):
        raise ValueError("an edge of the source to itself cannot be dealt out")
    names = settled(aliases.where((F.col("entity_id") == entity_id) & F.col("retracted_at").isNull() & (F.col("revealed_at") < at)))
    events = settled(participants.where((F.col("entity_id") == entity_id) & (F.col("revealed_at") < at)).select("event_id").distinct())
    for what, ids, given in (
        ("aliases", names.select(F.col("alias_id").alias("id")), alias_map),
        ("edges", mine.select(F.col("edge_id").alias("id")), edge_map),
        ("events", events.select(F.col("event_id").alias("id")), event_map),
    ):
        _complete(what, ids, given, parts)
    row = lambda df, kind, i, other: df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.col("part_id").alias("owner"), other.alias("other"))
    dealt = lambda df, key, given: df.join(given.withColumnRenamed("id", key), key)
    none = F.lit(None).cast("string")
    other = F.when(F.col("src_entity") == entity_id, F.col("dst_entity")).otherwise(F.col("src_entity"))
    out = row(parts, "entity", "part_id", F.col("canonical_name"))
    out = out.unionByName(row(dealt(names, "alias_id", alias_map), "alias", "alias_id", F.col("surface")))
    out = out.unionByName(row(dealt(mine, "edge_id", edge_map), "edge", "edge_id", other))
    return out.unionByName(row(dealt(events, "event_id", event_map), "event", "event_id", none))


def replacement_outcomes(requests: DataFrame, entities: DataFrame, receipts: DataFrame, at: int) -> DataFrame:
    """``request_id, outcome`` of asked-for names (``request_id, entity_id, name``), by the first check that
    fails: ``empty``, ``not-live``, ``same-name``, ``collision`` (another live entity of its type has the name)
    or ``no-receipt`` (``receipts``: ``entity_id`` of those whose chapter is committed); else ``replaced``."""
    key = lambda c: F.lower(F.trim(c))
    now = entities.where(live(at)).select("entity_id", "type", key(F.col("canonical_name")).alias("own"))
    holders = now.groupBy("type", F.col("own").alias("wanted")).agg(F.count(F.lit(1)).alias("holders"))
    rows = requests.withColumn("wanted", key(F.col("name"))).join(now, "entity_id", "left").join(holders, ["type", "wanted"], "left")
    rows = rows.join(receipts.select("entity_id").distinct().withColumn("committed", F.lit(True)), "entity_id", "left")
    outcome = (
        F.when(F.coalesce("wanted", F.lit("")) == "", "empty")
        .when(F.col("own").isNull(), "not-live")
        .when(F.col("own") == F.col("wanted"), "same-name")
        .when(F.col("holders").isNotNull(), "collision")
        .when(F.col("committed").isNull(), "no-receipt")
        .otherwise("replaced")
    )
    return rows.select("request_id", outcome.alias("outcome"))


@dataclass(frozen=True)
class Story:
    """The tables that an identity's dependents are in."""

    entities: DataFrame
    aliases: DataFrame
    edges: DataFrame
    events: DataFrame
    participants: DataFrame
    states: DataFrame


def _seen(at: int, ends: bool = True) -> Column:
    """Revealed by ``at`` (not only before it), standing and, where it can end, not ended."""
    ok = F.col("retracted_at").isNull() & (F.col("revealed_at") <= at)
    return ok & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)) if ends else ok


ROW = ("kind", "source", "target", "id", "text", "label", "src", "dst", "until")


def _row(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    given = {"kind": F.lit(kind), "source": F.col("source"), "target": F.col("target")} | given
    return df.select(*[given.get(c, none).cast("int" if c == "until" else "string").alias(c) for c in ROW])


def _edges(story: Story, to: DataFrame, at: int) -> DataFrame:
    """The edges of the sources ``to`` (``source, target`` and more), each once: ``src_to`` and ``dst_to`` hold what ``to`` has of its ends."""
    ends = story.entities.where(_seen(at)).select("entity_id").distinct()
    who = ends.join(to.withColumnRenamed("source", "entity_id").select("entity_id", F.struct(*[c for c in to.columns if c != "source"]).alias("to")), "entity_id", "left")
    edges = story.edges.where(_seen(at)).select("edge_id", "src_entity", "dst_entity", "rel_type", "label", "invalid_at")
    for c in ("src", "dst"):
        edges = edges.join(who.select(F.col("entity_id").alias(f"{c}_entity"), F.col("to").alias(f"{c}_to")), f"{c}_entity")
    return edges.where("src_to is not null or dst_to is not null")


def _moved(c: str) -> Column:
    return F.coalesce(f"{c}_to.target", f"{c}_entity")


def inventory(story: Story, remap: DataFrame, at: int) -> DataFrame:
    """All that hangs on the sources of ``remap`` (``old_id, new_id``) at ``at``: ``kind, source, target, id, text, label,
    src, dst, until``, a row each. An edge is one row per source at its ends, already led to the targets; of
    states the current one counts; edges need both ends, participations their event."""
    to = remap.select(F.col("old_id").alias("source"), F.col("new_id").alias("target"))
    of = lambda df: df.join(to, F.col("entity_id") == F.col("source"))
    own = _row(of(story.entities.where(live(at))), "entity", id=F.col("entity_id"), text=F.col("canonical_name"), label=F.col("type"))
    names = _row(of(story.aliases.where(_seen(at, False))), "alias", id=F.col("alias_id"), text=F.col("surface"))

    edges = _edges(story, to, at)
    touched = F.array_compact(F.array(*[F.when(F.col(f"{c}_to").isNotNull(), F.struct(F.col(f"{c}_entity").alias("source"), F.col(f"{c}_to.target").alias("target"))) for c in ("src", "dst")]))
    edges = edges.select("*", F.explode(F.array_distinct(touched)).alias("own")).select("*", "own.source", "own.target")
    relations = _row(edges, "edge", id=F.col("edge_id"), text=F.col("rel_type"), label=F.col("label"), until=F.col("invalid_at"), src=_moved("src"), dst=_moved("dst"))

    shown = story.events.where(_seen(at)).select("event_id")
    people = of(story.participants.where(F.col("revealed_at") <= at)).join(shown, "event_id", "left_semi")
    roles = _row(people, "participant", id=F.col("event_id"), text=F.col("role"))

    newest = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("revealed_at"), F.desc("state_id")))
    states = story.states.where(_seen(at)).join(to, F.col("entity_id") == F.col("source")).withColumn("n", newest).where("n = 1")
    current = _row(states, "state", id=F.col("state_id"), text=F.col("status_json"))
    return own.unionByName(names).unionByName(relations).unionByName(roles).unionByName(current)


def _refuse(rows: DataFrame, why: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise ValueError(f"{why}: {found[0][0]}")


def correct(story: Story, remap: DataFrame, at: int, *, roles: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The change log ``op, kind, id, entity, text, label, src, dst, until`` of corrections at ``at``: sources end, targets and all
    their dependents are added.

    ``remap``: ``old_id, new_id, new_name``; a target with several sources is a merge, one with a single source a
    replacement. Former names become aliases, each spelling once and none like the new name. A merge's edges
    lose loops and repeats; its roles must agree, or be settled by ``roles`` (``target, event_id, role``); its state is the one
    given in ``states`` (``target, status_json``), a replacement keeps the current one. Refused: sources that are not
    live, an empty name or several, the name it had, types that differ, roles that differ, roles for events that
    no source has.
    """
    df = remap.sparkSession.createDataFrame
    remap = settled(remap.select("old_id", "new_id", "new_name"))
    found = story.entities.where(live(at)).select(F.col("entity_id").alias("old_id"), "canonical_name", "type")
    _refuse(remap.join(found, "old_id", "left_anti").select("old_id"), "a source is not live")
    _refuse(remap.groupBy("old_id").count().where("count > 1").select("old_id"), "a source has two targets")
    of = settled(remap.join(found, "old_id").groupBy("new_id").agg(
        F.count(F.lit(1)).alias("sources"), F.count_distinct("type").alias("types"), F.first("type").alias("type"), F.count_distinct(F.trim("new_name")).alias("names"),
        F.trim(F.first("new_name", True)).alias("name"), F.first(F.lower(F.trim("canonical_name"))).alias("had"),
    ))
    _refuse(of.where("coalesce(name, '') = '' or names > 1").select("new_id"), "a target needs one name")
    _refuse(of.where("types > 1").select("new_id"), "sources of different types")
    _refuse(of.where((F.col("sources") == 1) & (F.col("had") == F.lower("name"))).select("new_id"), "the name is the one it had")

    rows = inventory(story, remap, at).join(of.select(F.col("new_id").alias("target"), (F.col("sources") > 1).alias("merge"), "name", F.col("type").alias("kept")), "target")
    roles = df([], "target string, event_id string, role string") if roles is None else roles.select("target", F.col("event_id").cast("string").alias("event_id"), "role")
    told = rows.where("kind = 'participant'").groupBy("target", F.col("id").alias("event_id")).agg(
        F.array_sort(F.collect_set("text")).alias("roles"), F.bool_or("merge").alias("merge")
    )
    told = settled(told.join(roles, ["target", "event_id"], "left"))
    _refuse(roles.join(told, ["target", "event_id"], "left_anti").select("event_id"), "a role for an unknown event")
    _refuse(told.where(F.col("merge") & F.col("role").isNull() & (F.size("roles") > 1)).select("event_id"), "an event has conflicting roles")
    played = told.select("target", "event_id", F.explode(F.when(F.col("role").isNotNull(), F.array("role")).otherwise(F.col("roles"))).alias("role"))

    none = F.lit(None).cast("string")

    def log(frame: DataFrame, op: str, kind: str, **given: Column) -> DataFrame:
        given = {"op": F.lit(op), "kind": F.lit(kind), "entity": F.col("target")} | given
        return frame.select(*[given.get(c, none).cast("int" if c == "until" else "string").alias(c) for c in LOG])

    sources = rows.where("kind = 'entity'")
    out = log(sources, "end", "entity", id=F.col("id"), until=F.lit(at))
    out = out.unionByName(log(sources.select("target", "name", "kept").distinct(), "add", "entity", id=F.col("target"), text=F.col("name"), label=F.col("kept")))
    spelt = rows.where("kind in ('entity', 'alias')").where(F.lower("text") != F.lower("name"))
    first = F.min(F.struct(F.when(F.col("kind") == "entity", 0).otherwise(1).alias("k"), "id", "text"))
    spelt = spelt.groupBy("target", F.lower("text").alias("key")).agg(first.alias("f"))
    out = out.unionByName(log(spelt, "add", "alias", id=F.col("f.id"), text=F.col("f.text")))
    # An edge between two targets is one edge; a merge's equal edges are one too.
    to = remap.join(of.select("new_id", (F.col("sources") > 1).alias("merge")), "new_id").select(F.col("old_id").alias("source"), F.col("new_id").alias("target"), "merge")
    moved = _edges(story, to, at).select(
        F.col("edge_id").cast("string").alias("id"), _moved("src").alias("src"), _moved("dst").alias("dst"), F.col("rel_type").alias("text"), F.col("label").cast("string").alias("label"), F.col("invalid_at").cast("int").alias("until"),
        (F.coalesce("src_to.merge", F.lit(False)) | F.coalesce("dst_to.merge", F.lit(False))).alias("merge"), F.least("src_to.target", "dst_to.target").alias("target"),
    )
    moved = moved.where(~F.col("merge") | (F.col("src") != F.col("dst")))
    moved = moved.groupBy("src", "dst", "text", "label", "until", F.when(F.col("merge"), "").otherwise(F.col("id")).alias("apart")).agg(F.min("id").alias("id"), F.min("target").alias("target"))
    out = out.unionByName(log(moved, "add", "edge", **{c: F.col(c) for c in ("id", "text", "label", "src", "dst", "until")}))
    out = out.unionByName(log(played, "add", "participant", id=F.col("event_id"), text=F.col("role")))
    kept = rows.where("kind = 'state' and not merge").select("target", "id", "text")
    if states is not None:
        kept = kept.unionByName(states.join(of.where("sources > 1").select(F.col("new_id").alias("target")), "target").select("target", none.alias("id"), F.col("status_json").alias("text")))
    return out.unionByName(log(kept, "add", "state", id=F.col("id"), text=F.col("text")))


LOG = ("op", "kind", "id", "entity", "text", "label", "src", "dst", "until")


def applied(story: Story, changes: DataFrame, at: int) -> Story:
    """The story after a change log. What is added is revealed at ``at``; a continued edge or state has its source's number
    negated, a new alias a hash of its identity and name."""
    here, none, gone = F.lit(at).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("timestamp")
    add = lambda kind: changes.where((F.col("op") == "add") & (F.col("kind") == kind))
    time = {"revealed_at": here, "invalid_at": none, "retracted_at": gone}

    def joined(old: DataFrame, new: DataFrame, **given: Column) -> DataFrame:
        given = time | given
        return old.unionByName(new.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in old.schema.fields]))

    ended = changes.where("op = 'end'").select(F.col("id").alias("entity_id"), F.col("until").alias("_until"))
    entities = story.entities.join(ended, "entity_id", "left").withColumn("invalid_at", F.coalesce("_until", "invalid_at")).select(*story.entities.columns)
    return replace(
        story,
        entities=joined(entities, add("entity"), entity_id=F.col("entity"), canonical_name=F.col("text"), type=F.col("label")),
        aliases=joined(story.aliases, add("alias"), alias_id=F.xxhash64("entity", "text"), entity_id=F.col("entity"), surface=F.col("text")),
        edges=joined(story.edges, add("edge"), edge_id=-F.col("id").cast("long"), src_entity=F.col("src"), dst_entity=F.col("dst"), rel_type=F.col("text"), label=F.col("label"), invalid_at=F.col("until")),
        participants=joined(story.participants, add("participant"), event_id=F.col("id"), entity_id=F.col("entity"), role=F.col("text")),
        states=joined(story.states, add("state"), state_id=F.coalesce(-F.col("id").cast("long"), F.xxhash64("entity", "text")), entity_id=F.col("entity"), status_json=F.col("text")),
    )
