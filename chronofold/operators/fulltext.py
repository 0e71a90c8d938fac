"""Full-text search over word arrays: web-style queries, cover-density rank, headlines.

A query is an alternative of groups, a group a conjunction of units, a unit a word or a
phrase, wanted or not. All of it becomes one column expression, so a search is a filter
and a projection of the scan and needs no index; documents are read whole.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}]+"
WEIGHT = 0.1  # fixed value: what a cover without gaps adds
MOST_WORDS = 36


class Unit(NamedTuple):
    words: tuple[str, ...]
    wanted: bool = True


def parse_web(query: str) -> list[list[Unit]]:
    """Quotes make phrases, ``or`` alternatives, a leading minus what must not occur; the rest is wanted. An
    open quote runs to the end. A part of several words (``foo-bar``) is a phrase; one without words is nothing."""
    groups: list[list[Unit]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)(?:"|$)|([^\s"]+))', query):
        if not minus and bare.lower() == "or":
            groups.append([])
            continue
        words = tuple(re.findall(r"[^\W_]+", (quoted or bare).lower()))
        if words:
            groups[-1].append(Unit(words, not minus))
    return [g for g in groups if g]


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _ends(w: Column, unit: Unit, x: Column, i: Column) -> Column:
    """Whether the unit's last word is ``x``, word ``i`` (from 0) of ``w``."""
    last = len(unit.words) - 1
    before = [F.get(w, i - (last - j)) == unit.words[j] for j in range(last)]
    return F.coalesce(reduce(lambda a, b: a & b, before, x == unit.words[-1]), F.lit(False))


def _occurs(w: Column, unit: Unit) -> Column:
    if len(unit.words) == 1:
        return F.array_contains(w, unit.words[0])
    return F.exists(F.transform(w, lambda x, i: _ends(w, unit, x, i)), lambda h: h)


def matches(w: Column, groups: list[list[Unit]]) -> Column:
    """Whether a word array satisfies one of the groups. A query without units matches nothing."""
    each = [reduce(lambda a, b: a & b, [_occurs(w, u) if u.wanted else ~_occurs(w, u) for u in g]) for g in groups]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def text_matches(text: Column, groups: list[list[Unit]]) -> Column:
    """``matches`` of the words of a text, without an array of them: words between single blanks, made once a text."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))

    def told(s: Column) -> Column:
        has = lambda u: s.contains(f" {' '.join(u.words)} ")
        each = [reduce(lambda a, b: a & b, [has(u) if u.wanted else ~has(u) for u in g]) for g in groups]
        return reduce(lambda a, b: a | b, each, F.lit(False))

    return F.exists(F.array(spaced), told)


def _wanted(groups: list[list[Unit]]) -> list[Unit]:
    return list(dict.fromkeys(u for g in groups for u in g if u.wanted))


def _hits(w: Column, units: list[Unit]) -> Column:
    """Occurrences of the units in the order of their ends: ``s, e`` (word numbers), ``u``, ``n`` (words)."""

    def at(x: Column, i: Column) -> Column:
        found = [
            F.when(_ends(w, u, x, i), F.struct((i - (len(u.words) - 1)).alias("s"), i.alias("e"), F.lit(k).alias("u"), F.lit(len(u.words)).alias("n")))
            for k, u in enumerate(units)
        ]
        return F.array_compact(F.array(*found))

    return F.flatten(F.transform(w, at))


def rank_cover_density(w: Column, groups: list[list[Unit]]) -> Column:
    """The sum over all covers (shortest stretches that hold a group's wanted units) of ``WEIGHT`` / (1 + words
    in it that are no hits)."""
    units = _wanted(groups)
    if not units:
        return F.lit(0.0)
    sets = [[units.index(u) for u in g if u.wanted] for g in groups]
    sets = [s for s in sets if s]
    unseen = F.array(*[F.lit(-1)] * len(units))
    start = F.struct(unseen.alias("last"), unseen.alias("held"), F.lit(0).alias("k"), F.lit(-1).alias("prev"), F.lit(0.0).alias("score"))

    def step(a: Column, h: Column) -> Column:
        put = lambda c, v: F.transform(c, lambda o, j: F.when(j == h["u"], v).otherwise(o))
        last, held, k = put(a["last"], h["s"]), put(a["held"], a["k"]), a["k"] + h["n"]
        # Per group the start of its shortest stretch that ends here (-1: a unit is missing) and the hits before it.
        reach = [F.struct(F.array_min(F.array(*[F.get(last, F.lit(u)) for u in s])).alias("s"), F.array_min(F.array(*[F.get(held, F.lit(u)) for u in s])).alias("k")) for s in sets]
        best = F.array_max(F.array(*reach))
        new = best["s"] > a["prev"]
        n = k - best["k"]
        gap = h["e"] - best["s"] - (n - 1)
        gap = F.when(gap < 0, F.floor((n - 1) / 2).cast("int")).otherwise(gap)
        return F.struct(
            last.alias("last"), held.alias("held"), k.alias("k"), F.when(new, best["s"]).otherwise(a["prev"]).alias("prev"),
            F.when(new, a["score"] + WEIGHT / (1 + gap)).otherwise(a["score"]).alias("score"),
        )

    return F.aggregate(_hits(w, units), start, step, lambda a: a["score"])


def _occurrences(words: list[str], units: list[Unit]) -> list[tuple[int, int, int]]:
    """``(start, end, unit)`` of the units in a text, by their ends."""
    found = []
    for e in range(len(words)):
        for k, u in enumerate(units):
            s = e - len(u.words) + 1
            if s >= 0 and tuple(words[s : e + 1]) == u.words:
                found.append((s, e, k))
    return found


def covers(hits: list[tuple[int, int, int]], sets: list[list[int]]) -> list[tuple[int, int]]:
    """The shortest stretches that hold all units of one of the sets, each start once, by their ends."""
    last: dict[int, int] = {}
    out, before = [], -1
    for s, e, k in hits:
        last[k] = s
        starts = [min(last[u] for u in one) for one in sets if all(u in last for u in one)]
        if starts and max(starts) > before:
            before = max(starts)
            out.append((before, e))
    return out


def fragments(length: int, marked: list[int], found: list[tuple[int, int]], count: int, least: int, most: int) -> list[tuple[int, int]]:
    """Up to ``count`` stretches of a text of ``length`` words around covers, in the order of the text.

    The cover with the most ``marked`` words in its first ``most`` words comes first (of several the shorter, then the earlier). It is
    grown to ``most`` words, to both sides alike, as far as the text and earlier fragments leave room; the next ones are
    chosen among the covers outside of what was chosen, and go where they stay under ``least`` words.
    """
    cut = sorted({(s, min(e, s + most - 1)) for s, e in found}, key=lambda c: (-sum(c[0] <= m <= c[1] for m in marked), c[1] - c[0], c[0]))
    chosen: list[tuple[int, int]] = []
    for s, e in cut:
        if len(chosen) == count:
            break
        if any(s <= b and a <= e for a, b in chosen):
            continue
        low = max((b + 1 for a, b in chosen if b < s), default=0)
        high = min((a - 1 for a, b in chosen if a > e), default=length - 1)
        first = max(low, s - (most - (e - s + 1)) // 2)
        last = min(high, first + most - 1)
        first = max(low, last - most + 1)
        if last - first + 1 >= least or not chosen:
            chosen.append((first, last))
    return sorted(chosen)


def headline(w: Column, groups: list[list[Unit]], count: int = 1, least: int = 12, most: int = MOST_WORDS, marks: tuple[str, str] = ("[", "]")) -> Column:
    """Fragments of a word array around the query's covers, hits between ``marks``, joined by an ellipsis; the first ``least``
    words where nothing is covered. It is made for rows that are returned, row by row."""
    units = _wanted(groups)
    sets = [s for s in ([units.index(u) for u in g if u.wanted] for g in groups) if s]
    wanted = {x for u in units for x in u.words}

    def one(words) -> str | None:
        words = list(words) if words is not None else []
        hits = _occurrences(words, units)
        marked = [i for i, x in enumerate(words) if x in wanted]
        parts = fragments(len(words), marked, covers(hits, sets), count, least, most)
        show = lambda i: f"{marks[0]}{words[i]}{marks[1]}" if words[i] in wanted else words[i]
        return " ... ".join(" ".join(map(show, range(a, b + 1))) for a, b in parts) if parts else " ".join(words[:least])

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return made(w)


def search(docs: DataFrame, query: str, *, key: str, limit: int, text: str = "text", **shape) -> DataFrame:
    """The ``limit`` best rows of ``docs`` (which the caller has filtered): their columns, ``score`` and
    ``headline`` (``shape``: its ``count``, ``least``, ``most`` and ``marks``); ties go to the least ``key``. Headlines are made
    for the rows that are returned only."""
    groups = parse_web(query)
    rows = docs.withColumn("_w", text_words(F.col(text))).where(matches(F.col("_w"), groups))
    top = rows.withColumn("score", rank_cover_density(F.col("_w"), groups)).orderBy(F.desc("score"), key).limit(limit)
    return top.withColumn("headline", headline(F.col("_w"), groups, **shape)).drop("_w")


def sources(ranked: DataFrame, *, key: str, limit: int = 6, most: int = 2_000, text: str = "text") -> DataFrame:
    """``n, key, passage, score``: the first ``limit`` different passages of ``ranked`` (rows with ``score``), blanks collapsed and cut to ``most``
    characters, numbered from 1; blank ones are left out, of equal ones the best (then the least ``key``) counts. Only digests and the
    passages' cuts are shuffled."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    rows = ranked.select(key, "score", plain.alias("_t")).where("_t <> ''")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.left("_t", F.lit(most)).alias("passage"))).alias("b")
    top = rows.groupBy(F.sha2("_t", 256)).agg(best).select("b.*").orderBy("s", "k").limit(limit)
    place = F.row_number().over(Window.orderBy("s", "k"))  # of ``limit`` rows
    return top.select(place.cast("long").alias("n"), F.col("k").alias(key), "passage", (-F.col("s")).alias("score"))
