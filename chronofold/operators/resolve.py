"""Layered identity resolution of mentions against a roster, as joins on merge keys.

``mentions``: ``mention_id, type, name, aliases, linked``; ``roster``: ``entity_id, type,
name, aliases``; both may have further key columns ``scope`` (a book), and ``vec``. Only
entities of the mention's type and scope count. The first layer with a hit decides:

1. ``roster-link``: a mention that claims a link, with the canonical name itself (the least identifier);
2. ``roster-fuzzy``: one that claims a link, with two name words or more, all of them in one entity's name;
3. ``exact``: the canonical name;
4. ``honorific``: a title and one name word, against the same or the bare name word;
5. ``alias``: any name-like form, possessives removed;
6. ``embedding``: the best cosine of 0.82 or more that is 0.05 clear of the second (only with ``vec``).

Layers 3 to 5 with several entities are ambiguous: a new identity, with ``warn``. Layer 2 with several, or
none, passes on. A mention that claims a link and finds none is new, with ``warn``. A form of titles, role
nouns and pronouns alone is no key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import text as X
from chronofold.operators.vectors import cosine
from chronofold.sources.shared import settled

THRESHOLD, MARGIN = 0.82, 0.05


def _bare(form: Column) -> Column:
    """The name word of a form that is just that."""
    key = X.name_key(form)
    return F.when(~F.contains(key, F.lit(" ")) & (F.size(X.proper_tokens(form)) == 1), key)


def _keyed(rows: DataFrame) -> DataFrame:
    forms = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    every = lambda f: F.array_distinct(F.filter(F.transform(forms, f), lambda k: k.isNotNull()))
    return (
        rows.withColumn("_exact", X.normalise_fast(F.col("name")))
        .withColumn("_tokens", F.array_distinct(X.proper_tokens(F.col("name"))))
        .withColumn("_hon", every(X.honorific_key))
        .withColumn("_bare", every(_bare))
        .withColumn("_forms", every(lambda f: F.when(F.size(X.proper_tokens(f)) > 0, X.name_key(f))))
    )


def resolve(mentions: DataFrame, roster: DataFrame, *, scope: tuple[str, ...] = (), threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """One row per mention: ``*scope, mention_id, entity_id, method, score, warn``."""
    keys = [*scope, "type"]
    m, r = _keyed(mentions), _keyed(roster)
    named = F.size("_tokens") > 0

    def layer(rank: int, name: str, left: DataFrame, right: DataFrame, lk: Column, rk: Column, keep: Column | None = None) -> DataFrame:
        a = left.select(*keys, "mention_id", F.col("_tokens").alias("_mt"), F.explode(lk).alias("_k"))
        b = right.select(*keys, "entity_id", F.col("_tokens").alias("_rt"), F.explode(rk).alias("_k"))
        pairs = a.join(b, [*keys, "_k"])
        pairs = pairs if keep is None else pairs.where(keep)
        found = pairs.groupBy(*scope, "mention_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
        return found.select(*scope, "mention_id", F.lit(rank).alias("rank"), F.lit(name).alias("method"), "n", "entity_id")

    exact = F.array("_exact")
    linked = m.where("linked")
    subset = F.size(F.array_except("_mt", "_rt")) == 0
    titled = F.transform(F.array_union("_hon", "_bare"), lambda k: F.concat(F.lit("h"), k))
    hits = [
        layer(1, "roster-link", linked, r.where(named), exact, exact).withColumn("n", F.lit(1).cast("long")),
        # A subset's first word is among the entity's words.
        layer(2, "roster-fuzzy", linked.where(F.size("_tokens") >= 2), r, F.slice("_tokens", 1, 1), F.col("_tokens"), subset).where("n = 1"),
        layer(3, "exact", m.where(named), r, exact, exact),
        # Titled forms meet titled and bare ones, bare forms meet titled ones.
        layer(
            4, "honorific", m, r,
            F.concat(F.transform("_hon", lambda k: F.concat(F.lit("h"), k)), F.transform("_bare", lambda k: F.concat(F.lit("b"), k))),
            F.concat(titled, F.transform("_hon", lambda k: F.concat(F.lit("b"), k))),
        ),
        layer(5, "alias", m, r, F.col("_forms"), F.col("_forms")),
    ]
    first = reduce(DataFrame.unionByName, hits).groupBy(*scope, "mention_id").agg(F.min_by(F.struct("method", "n", "entity_id"), "rank").alias("f"))
    out = m.select(*scope, "mention_id", "linked").join(first, [*scope, "mention_id"], "left")
    sure, several = F.coalesce(F.col("f.n") == 1, F.lit(False)), F.coalesce(F.col("f.n") > 1, F.lit(False))
    score = F.when(F.col("f.method") == "roster-fuzzy", 0.9).otherwise(1.0)
    if "vec" in mentions.columns and "vec" in roster.columns:
        out = out.join(_nearest(m, r, first, keys, scope, threshold, margin), [*scope, "mention_id"], "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("struct<score:double,entity_id:string>"))
    near = F.col("f").isNull() & F.col("near").isNotNull()
    return out.select(
        *scope,
        "mention_id",
        F.when(sure, F.col("f.entity_id")).when(near, F.col("near.entity_id")).alias("entity_id"),
        F.when(sure, F.col("f.method")).when(near, "embedding").otherwise("new").alias("method"),
        F.when(sure, score).when(near, F.col("near.score")).otherwise(0.0).alias("score"),
        (several | (F.col("f").isNull() & ~near & F.coalesce("linked", F.lit(False)))).alias("warn"),
    )


def _nearest(m: DataFrame, r: DataFrame, first: DataFrame, keys: list[str], scope: tuple[str, ...], threshold: float, margin: float) -> DataFrame:
    """``near`` (score, entity_id) of mentions without a hit. The best and the second are two aggregates, so no
    mention's candidates are sorted or collected."""
    left = m.join(first, [*scope, "mention_id"], "left_anti").select(*keys, "mention_id", F.col("vec").alias("_mv"))
    pairs = left.join(r.select(*keys, "entity_id", F.col("vec").alias("_rv")), keys)
    pairs = pairs.select(*scope, "mention_id", cosine(F.col("_mv"), F.col("_rv")).alias("score"), "entity_id").where("score is not null")
    best = pairs.groupBy(*scope, "mention_id").agg(F.max(F.struct("score", "entity_id")).alias("near")).where(F.col("near.score") >= threshold)
    second = pairs.join(best, [*scope, "mention_id"]).where(F.col("entity_id") != F.col("near.entity_id")).groupBy(*scope, "mention_id").agg(F.max("score").alias("second"))
    return best.join(second, [*scope, "mention_id"], "left").where(F.col("near.score") - F.coalesce("second", F.lit(0.0)) >= margin).drop("second")


def resolve_in_order(mentions: DataFrame, roster: DataFrame, *, book: str, order: str) -> DataFrame:
    """Every mention of a book in its ``order`` (1, 2, ... without gaps), against a roster that grows by each
    new identity (``new:<mention_id>``): ``book, mention_id, entity_id, method, score, warn``. All books go
    through a round together; there are as many rounds as the book with the most mentions has. A round is
    checkpointed, and reads only its own mentions and the roster of their books."""
    last = mentions.agg(F.max(order)).first()[0] or 0
    columns = [book, "entity_id", "type", "name", "aliases"]
    work, out = settled(roster.select(*columns)), None
    for step in range(1, last + 1):
        now = mentions.where(F.col(order) == step)
        found = resolve(now, work.join(now.select(book).distinct(), book, "left_semi"), scope=(book,))
        found = settled(found.withColumn("entity_id", F.coalesce("entity_id", F.concat(F.lit("new:"), F.col("mention_id").cast("string")))))
        fresh = now.join(found.where("method = 'new'").select(book, "mention_id", "entity_id"), [book, "mention_id"])
        work = settled(work.unionByName(fresh.select(*columns)))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else resolve(mentions, roster, scope=(book,))


def coalesce_honorifics(entities: DataFrame) -> DataFrame:
    """``old_id, new_id``: entities (``id, name``) of a title and one name, and the entity of that name alone they fold into.
    A name that several bear alone folds nothing."""
    t = entities.withColumn("t", F.split(X.normalise_fast(F.col("name")), " "))
    single = t.where("size(t) = 1").groupBy(F.get("t", F.lit(0)).alias("k")).agg(F.min("id").alias("new_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    titled = t.where((F.size("t") == 2) & F.rtrim(F.get("t", F.lit(0)), F.lit(".")).isin(*X.FOLD_HONORIFICS)).select(F.col("id").alias("old_id"), F.get("t", F.lit(1)).alias("k"))
    return titled.join(single.select("k", "new_id"), "k").select("old_id", "new_id")
