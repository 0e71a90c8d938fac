"""Removal of repeated byte strings, with suffix arrays built by Lyndon-prefix grouping.

Every byte covered by a ``LENGTH``-byte string that starts at least twice in the corpus
is removed. Texts are cut into UTF-8 bytes; matches never cross documents.

1. Anchors. Each window of LENGTH bytes names the ``GRAM``-byte strings in it with the
   least hash. Equal windows name equal anchors at equal offsets, so a window can only
   repeat if its anchor's hash does. Hashes are counted over all documents; those counted
   more than once set a bit each in a bitmap of fixed size (``FILTER_BITS``), which is
   broadcast. A false bit costs time, not correctness.
2. Contexts. At each anchor that passes, the bytes that windows around it can reach are
   sent to the anchor's group; equal contexts of a task are sent once, with all their
   places. The hottest hashes (a fixed number at most) are first split by what their
   windows have in common, so that no task gets one whole.
3. Suffix arrays. In a group, windows are taken by ranges of the anchor's offset. All
   windows of a range share a core; contexts with equal cores make strings of the bytes
   left of the core, the core as one symbol, and the bytes right of it, which are sorted
   by the linear Lyndon grouping (``lyndon.py``), several sets with a core symbol each in a string. Windows that are neighbours in that order
   and agree in full are repeated. A context that occurs twice repeats all its windows. A
   set of more than ``MOST`` strings is halved by offset, down to single windows, whose
   core is all of them, so the work stays in proportion to the input.
4. The repeated windows around an anchor all hold it, so they cover one run of bytes; a
   document's runs are merged and cut out. A second bitmap of that size tells which texts
   may have runs; only those are shuffled to them.

Defined results: a null text is empty, an empty one has nothing to remove; text that is
shorter than LENGTH bytes stays; of repeated rows each is removed (each is elsewhere for
the others); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import settled, shuffle_partitions, stored, table
from chronofold.llm.jaccard_join import grouped
from chronofold.llm.lyndon import _ragged, suffix_arrays

LENGTH = 200
GRAM = 64
OFFSETS = LENGTH - GRAM + 1  # an anchor lies 0 .. OFFSETS - 1 bytes behind a window's start
PARTS = 8
STEP = -(-OFFSETS // PARTS)
MOST = 64
SYMBOLS = 1_000_000
AT_ONCE = 65_536
STRINGS = (4, 16, MOST)  # contexts a string, for sets of at most so many
FILTER_BITS = 1 << 27
HOT_PER_PARTITION = 16
HOT_LEAST = 4_096
SPANS = "array<struct<s:int,e:int>>"
BLOCK_BYTES = 1 << 20
LEFT = OFFSETS - 1
WIDTH = LEFT + LENGTH
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9))
INVERSE = np.uint64(pow(int(MIX[1]), -1, 1 << 64))


def _slide(f, a: np.ndarray, width: int) -> np.ndarray:
    """f over each ``width`` neighbours."""
    s = 1
    while s * 2 <= width:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: -(width - s)], a[width - s :]) if width > s else a


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's anchors."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = []
    for c in range(0, len(raw), BLOCK_BYTES):
        lo, hi = max(0, c - LENGTH), min(len(raw), c + BLOCK_BYTES + 2 * LENGTH)
        if hi - lo < LENGTH:
            lo = hi - LENGTH
        h, p = _anchors(raw[lo:hi])
        p = p + lo
        own = (p >= c) & (p < c + BLOCK_BYTES)
        found.append((h[own], p[own]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = (raw.astype(np.uint64) + np.uint64(1)) * MIX[0]
    s = 1
    while s < GRAM:  # the hash of 2s bytes from those of s bytes
        h = h[:-s] * MIX[1] + h[s:]
        h ^= h >> np.uint64(31)
        h *= MIX[2]
        s *= 2
    least = _slide(np.minimum, h, OFFSETS)
    edge = np.zeros(OFFSETS - 1, np.uint64)
    best = _slide(np.maximum, np.concatenate([edge, least, edge]), OFFSETS)
    at = np.flatnonzero(best == h)
    return h[at], at


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(FILTER_BITS)


def ranges() -> list[tuple[int, int]]:
    return [(a, min(a + STEP, OFFSETS)) for a in range(0, OFFSETS, STEP)]


class Contexts:
    """Contexts of anchors as rows of bytes, aligned at the anchor; ``la`` bytes are there on the left and
    ``ra`` on the right."""

    def __init__(self, rows: np.ndarray, la: np.ndarray, ra: np.ndarray):
        self.rows, self.la, self.ra = rows, la, ra
        self.columns = np.ascontiguousarray(rows.T)
        self.sums = {0: np.zeros(len(rows), np.uint64)}  # of the bytes before a column
        for j in sorted({j for a, b in ranges() for j in (LEFT - a, LEFT - (b - 1), LEFT + LENGTH - b + 1, LEFT + LENGTH - a)}):
            self.prefix(j)
        self.power = np.array([pow(int(MIX[1]), j, 1 << 64) for j in range(WIDTH + 1)], np.uint64)

    def prefix(self, end: int) -> np.ndarray:
        if end not in self.sums:
            start = max(j for j in self.sums if j < end)
            h = self.sums[start].copy()
            for j in range(start, end):
                h += self.columns[j]
                h += np.uint64(1)
                h *= MIX[1]
            self.sums[end] = h
        return self.sums[end]

    def hash(self, who: np.ndarray, start: int, end: int) -> np.ndarray:
        """Of the bytes from ``start`` up to ``end``, counted from the anchor."""
        s, e = LEFT + start, LEFT + end
        h = self.prefix(e)[who] - self.prefix(s)[who] * self.power[e - s]
        h ^= h >> np.uint64(29)
        return h * MIX[2]

    def differ(self, members: np.ndarray, at: np.ndarray, start: int, end: int) -> np.ndarray:
        """Which ``members`` of those at ``at`` differ from the one before in columns ``start`` up to ``end``."""
        out = np.zeros(len(members), bool)
        for i in range(0, len(at), AT_ONCE):
            some = at[i : i + AT_ONCE]
            out[some] = (self.rows[members[some], start:end] != self.rows[members[some - 1], start:end]).any(1)
        return out

    def core(self, who: np.ndarray, a: int, b: int) -> np.ndarray:
        return self.hash(who, -a, LENGTH - b + 1)

    def span(self, who: np.ndarray, a: int, b: int) -> np.ndarray:
        """Of all that windows with offsets a .. b - 1 can reach, and how far it is there."""
        lack = np.minimum(self.la[who], b - 1).astype(np.uint64) * np.uint64(1_009) + np.minimum(self.ra[who], LENGTH - a).astype(np.uint64)
        return self.hash(who, -(b - 1), LENGTH - a) * MIX[1] + lack * MIX[0]

    def has(self, who: np.ndarray, a: int, b: int) -> np.ndarray:
        """Whether a window with an offset of a .. b - 1 lies inside the document."""
        return np.maximum(a, LENGTH - self.ra[who]) <= np.minimum(b - 1, self.la[who])


class Places:
    """Anchors at ``at`` in a text: rows of bytes around them, and hashes of the bytes from one distance of
    the anchor up to another, cut off where the text ends."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.at, self.n = at, len(raw)
        self.la, self.ra = np.minimum(at, LEFT), np.minimum(len(raw) - at, LENGTH)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
        self.rows = padded[at[:, None] + np.arange(WIDTH)[None, :]]
        power = np.full(len(raw) + 1, MIX[1])
        back = np.full(len(raw) + 1, INVERSE)
        power[0] = back[0] = np.uint64(1)
        self.back = np.cumprod(back)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:-1])])

    def hash(self, start: int, end: int) -> np.ndarray:
        s, e = np.maximum(self.at + start, 0), np.minimum(self.at + end, self.n)
        h = (self.prefix[e] - self.prefix[s]) * self.back[s]
        h ^= h >> np.uint64(29)
        return h * MIX[2]

    def core(self, a: int, b: int) -> np.ndarray:
        return self.hash(-a, LENGTH - b + 1)

    def span(self, a: int, b: int) -> np.ndarray:
        lack = np.minimum(self.la, b - 1).astype(np.uint64) * np.uint64(1_009) + np.minimum(self.ra, LENGTH - a).astype(np.uint64)
        return self.hash(-(b - 1), LENGTH - a) * MIX[1] + lack * MIX[0]

    def has(self, a: int, b: int) -> np.ndarray:
        return np.maximum(a, LENGTH - self.ra) <= np.minimum(b - 1, self.la)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def repeated(c: Contexts, group: np.ndarray, n: np.ndarray, tasks: list[tuple[np.ndarray, int, int]]):
    """Least and greatest offset of the repeated windows of each context (LENGTH and -1: none). ``group``
    numbers the contexts' groups and ``n`` counts the places of each; tasks name contexts and a range."""
    low, high = np.full(len(group), LENGTH), np.full(len(group), -1)

    def mark(who: np.ndarray, a, b) -> None:  # all windows with offsets a .. b - 1 that are there
        a, b = np.maximum(a, LENGTH - c.ra[who]), np.minimum(np.asarray(b) - 1, c.la[who])
        ok = a <= b
        np.minimum.at(low, who[ok], np.broadcast_to(a, ok.shape)[ok])
        np.maximum.at(high, who[ok], np.broadcast_to(b, ok.shape)[ok])

    sets: dict[int, list] = {}  # by width of the range
    while tasks:
        who, a, b = tasks.pop()
        who = who[c.has(who, a, b)]
        if not len(who):
            continue
        core, span = c.core(who, a, b), c.span(who, a, b)
        order = np.lexsort((span, core, group[who]))
        members, core, span = who[order], core[order], span[order]
        new_core = _changes(group[members], core)
        new = new_core | _changes(span)
        # Equal hashes are compared in full: neighbours' spans, and cores where the spans differ.
        new |= c.differ(members, np.flatnonzero(~new), LEFT - (b - 1), LEFT + LENGTH - a)
        new_core |= c.differ(members, np.flatnonzero(new & ~new_core), LEFT - a, LEFT + LENGTH - b + 1)
        head = np.flatnonzero(new)  # one context for all that agree in the range
        known = np.add.reduceat(n[members], head) > 1
        size = np.diff(np.r_[head, len(members)])
        mark(members[np.repeat(known, size)], a, b)
        start = np.flatnonzero(new_core[head])
        count = np.diff(np.r_[start, len(head)])
        sort = (count > 1) & ~np.logical_and.reduceat(known, start)  # where all is known, nothing is left to find
        large = np.repeat(sort & (count > MOST), count)
        if large.any():
            rest = members[np.repeat(large, size)]
            middle = (a + b) // 2
            tasks += [(rest, a, middle), (rest, middle, b)]
        small = np.flatnonzero(sort & (count <= MOST))
        if len(small):
            heads = _ragged(start[small], start[small] + count[small])
            sets.setdefault(b - a, []).append((count[small], members[head[heads]], np.full(len(heads), a), head[heads], size[heads], members))
    for w, parts in sets.items():
        count, heads, at = (np.concatenate([x[i] for x in parts]) for i in range(3))
        hit_low, hit_high = sorted_sets(c, count, heads, at, w)
        done = 0
        for _, _, _, begin, reach, members in parts:
            of = slice(done, done + len(begin))
            done += len(begin)
            some = hit_high[of] >= 0
            # What holds for a context holds for all that agree with it in the range.
            who = members[_ragged(begin[some], begin[some] + reach[some])]
            np.minimum.at(low, who, np.repeat(hit_low[of][some], reach[some]))
            np.maximum.at(high, who, np.repeat(hit_high[of][some], reach[some]))
    return low, high


def sorted_sets(c: Contexts, count: np.ndarray, heads: np.ndarray, a: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """``agreeing`` for sets of ``count`` contexts each, one set after another. Strings hold several sets, as many as
    fit, so that all have the same length and many are sorted at once."""
    low, high = np.full(len(heads), LENGTH), np.full(len(heads), -1)
    begin = np.cumsum(count) - count
    least = 0
    for most in STRINGS:
        some = np.flatnonzero((count > least) & (count <= most))
        some = some[np.argsort(-count[some], kind="stable")]
        least = most
        string, place, number, used, sets_there = [], [], [], most, 0
        lane = -1
        for k in count[some].tolist():
            if used + k > most:
                lane, used, sets_there = lane + 1, 0, 0
            string.append(lane)
            place.append(used)
            number.append(sets_there)
            used += k
            sets_there += 1
        size, string, place, number = count[some], np.array(string, np.int64), np.array(place, np.int64), np.array(number, np.int64)
        lanes = max(1, SYMBOLS // (2 * w * most))
        for i in range(0, lane + 1, lanes):
            own = (string >= i) & (string < i + lanes)
            where = _ragged(begin[some[own]], begin[some[own]] + size[own])
            first = (string[own] - i) * most + place[own]
            slot = _ragged(first, first + size[own])
            n = int(string[own].max()) - i + 1
            # Places that are left over hold some context, each as a set of its own, in which nothing repeats.
            held, offset = np.full(n * most, heads[where[0]]), np.full(n * most, a[where[0]])
            mark = np.tile(np.arange(most), n) + most
            held[slot], offset[slot], mark[slot] = heads[where], a[where], np.repeat(number[own], size[own])
            got = agreeing(c, held.reshape(n, most), offset, mark, w)
            low[where], high[where] = got[0][slot], got[1][slot]
    return low, high


def agreeing(c: Contexts, heads: np.ndarray, a: np.ndarray, mark: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings of contexts (strings x contexts): the least and greatest offset of the windows that another
    context of the set has too. Contexts with the same ``mark`` (below twice MOST) are a set and have a common core; a context's offsets are
    ``a .. a + w - 1``."""
    lanes, k = heads.shape
    who, b = heads.ravel(), a + w
    core, byte = MOST + 2, 3 * MOST + 2
    sep = np.tile(np.arange(1, k + 1), lanes)
    text = np.zeros((lanes * k, 2 * w), np.int64)
    j = np.arange(w - 1)
    here = j[None, :] >= (b - 1 - c.la[who])[:, None]
    left = c.rows[who[:, None], (LEFT - (b - 1))[:, None] + j]
    text[:, : w - 1] = np.where(here, left.astype(np.int64) + byte, sep[:, None])
    text[:, w - 1] = core + mark
    here = (LENGTH - b + 1)[:, None] + j < c.ra[who][:, None]
    right = c.rows[who[:, None], (LEFT + LENGTH - b + 1)[:, None] + j]
    text[:, w : 2 * w - 1] = np.where(here, right.astype(np.int64) + byte, sep[:, None])
    text[:, 2 * w - 1] = sep
    text = np.concatenate([np.zeros((lanes, 1), np.int64), text.reshape(lanes, -1)], 1)
    order = suffix_arrays(text)
    # A window's symbols are w long; it starts at one of the first w places of its context.
    valid = (order > 0) & ((order - 1) % (2 * w) < w)
    padded = np.concatenate([text, np.zeros((lanes, w), np.int64)], 1)
    same = np.zeros(order.shape, bool)  # with the one before in the order
    lane, at = np.nonzero(valid[:, 1:] & valid[:, :-1])
    x, y = order[lane, at], order[lane, at + 1]
    keep = np.arange(len(lane))
    for s in range(w):
        keep = keep[padded[lane[keep], x[keep] + s] == padded[lane[keep], y[keep] + s]]
    same[lane[keep], at[keep] + 1] = True
    hit = same.copy()
    hit[:, :-1] |= same[:, 1:]
    lane, at = np.nonzero(hit)
    pos = order[lane, at] - 1
    member = lane * k + pos // (2 * w)
    offset = b[member] - 1 - pos % (2 * w)
    inside = (offset <= c.la[who[member]]) & (LENGTH - offset <= c.ra[who[member]])
    low, high = np.full(lanes * k, LENGTH), np.full(lanes * k, -1)
    np.minimum.at(low, member[inside], offset[inside])
    np.maximum.at(high, member[inside], offset[inside])
    return low, high


def _key(docs: DataFrame):
    """With ``_did`` the identity of a row: equal only for repeated rows, whatever other identifiers hash to."""
    return F.xxhash64(docs["text"], docs["doc_id"])


def _did(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-1))


# Columns of ``occurrences``.
PLACE = {"g": "long", "ch": "long", "key": "long", "did": "long", "pos": "int", "la": "int", "ra": "int", "part": "int", "n": "long", "ctx": "binary"}


def anchor_counts(docs: DataFrame) -> DataFrame:
    """``h, n`` for hashes of anchors that occur more than once."""

    def count(batches):
        for pdf in batches:
            h = [anchors(_bytes(t))[0] for t in pdf["text"]]
            u, n = np.unique(np.concatenate(h) if h else np.zeros(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"h": u.view(np.int64), "n": n.astype(np.int64)})

    counted = docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.where("n > 1")


def bitmap(hashes: DataFrame) -> DataFrame:
    """``bucket, bits``: one bit per ``h``, FILTER_BITS in all, whatever the number of hashes."""
    bit = F.pmod(F.shiftrightunsigned("h", 20), F.lit(FILTER_BITS))
    return hashes.groupBy(F.floor(bit / 32_768).alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(pmod(pmod(shiftrightunsigned(h, 20), {FILTER_BITS}), 32768))").alias("bits")
    )


def gathered(parts: DataFrame) -> np.ndarray:
    """The bitmap in one piece of a fixed size."""
    out = np.zeros((FILTER_BITS // 32_768, 4_096), np.uint8)
    for r in parts.toPandas().itertuples():
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def occurrences(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``g, ch, key, pos, la, ra, part, n, ctx``: the places of anchors that may repeat. ``ch`` names a context
    of group ``g``. A task sends a context (``ctx``, the bytes before and
    behind the anchor, with ``n`` = 1) once; its further places there are counted
    in rows without a place."""
    spark = docs.sparkSession
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    most = HOT_PER_PARTITION * shuffle_partitions(spark)  # no more hashes than that can pass
    hot = [r["h"] for r in counts.where(F.col("n") >= max(HOT_LEAST, total / most)).select("h").collect()]
    shared = spark.sparkContext.broadcast((gathered(bitmap(counts)), np.sort(np.array(hot, np.int64).view(np.uint64))))

    def place(batches):
        bits, hottest = shared.value
        held, rows = [], 0
        more: dict[tuple[int, int], int] = {}  # further places of the contexts that were sent
        for pdf in batches:
            for key, did, text in zip(pdf["key"], pdf["did"], pdf["text"]):
                raw = _bytes(text)
                h, at = anchors(raw)
                bit = _bit(h)
                some = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                h, at = h[some > 0], at[some > 0]
                for c in range(0, len(raw) if len(at) else 0, BLOCK_BYTES):
                    own = (at >= c) & (at < c + BLOCK_BYTES)
                    first = max(0, c - LEFT)
                    if own.any():
                        p = Places(raw[first : c + BLOCK_BYTES + LENGTH], at[own] - first)
                        held.append(_placed(p, h[own], hottest, key, did, first, more))
                        rows += len(held[-1][0])
                if rows > 8_192:
                    yield framed(held)
                    held, rows = [], 0
            if len(more) > 400_000:
                yield counted(more)
                more.clear()
        if held:
            yield framed(held)
        yield counted(more)

    def framed(held: list[tuple]) -> pd.DataFrame:
        columns = {k: np.concatenate([x[i] for x in held]) for i, k in enumerate(list(PLACE)[:-1])}
        return pd.DataFrame(columns | {"ctx": pd.Series([c for x in held for c in x[-1]], dtype=object)})

    def counted(more: dict) -> pd.DataFrame:
        again = [(g, ch, n) for (g, ch), n in more.items() if n]
        out = pd.DataFrame(again, columns=["g", "ch", "n"]).astype(np.int64)
        return out.assign(key=pd.NA, did=pd.NA, pos=pd.NA, la=pd.NA, ra=pd.NA, part=pd.NA, ctx=None)[list(PLACE)]

    rows = docs.select(_key(docs).alias("key"), _did(docs).alias("did"), docs["text"])
    return rows.mapInPandas(place, ", ".join(f"{k} {v}" for k, v in PLACE.items()))


def _placed(p: Places, h: np.ndarray, hottest: np.ndarray, key: int, did: int, first: int, more: dict) -> tuple:
    """The columns of ``occurrences`` for some anchors of a text."""
    is_hot = np.isin(h, hottest)
    every = np.flatnonzero(~is_hot)
    out = [(every, h[every], np.full(len(every), -1), p.span(0, OFFSETS)[every])]
    if is_hot.any():
        for r, (a, b) in enumerate(ranges()):
            who = np.flatnonzero(is_hot & p.has(a, b))
            out.append((who, (h[who] + np.uint64(r + 1)) * MIX[0] ^ p.core(a, b)[who], np.full(len(who), r), p.span(a, b)[who]))
    who, g, part, ch = (np.concatenate([o[i] for o in out]) for i in range(4))
    g, ch = g.view(np.int64), (ch ^ (g * MIX[2])).view(np.int64)
    ctx, n, sides = [], [], np.concatenate([p.rows[:, :LEFT], p.rows[:, LEFT + GRAM :]], 1)
    for i, pair in zip(who.tolist(), zip(g.tolist(), ch.tolist())):
        if pair in more:
            more[pair] += 1
            ctx.append(None)
            n.append(0)
        else:
            more[pair] = 0
            ctx.append(sides[i].tobytes())
            n.append(1)
    return g, ch, np.full(len(g), key), np.full(len(g), did), p.at[who] + first, p.la[who], p.ra[who], part, np.array(n, np.int64), ctx


def runs(places: DataFrame) -> DataFrame:
    """``g, ch, low, high``: per context the offsets of its first and last repeated window."""

    def sort(batches):
        for pdf in grouped(batches, ["g"], AT_ONCE):
            total = pdf.groupby("ch", sort=False)["n"].sum()
            one = pdf[pdf["ctx"].notna()].drop_duplicates("ch")
            n = total.loc[one["ch"]].to_numpy(np.int64)
            group = pd.factorize(one["g"])[0]
            held = np.flatnonzero(np.bincount(group, n)[group] > 1)  # an anchor that occurs once repeats nothing
            if not len(held):
                continue
            one, n, group = one.iloc[held], n[held], group[held]
            rows = np.zeros((len(one), WIDTH), np.uint8)  # the anchor's own bytes are the same in all the group
            sides = np.frombuffer(b"".join(one["ctx"]), np.uint8).reshape(len(one), WIDTH - GRAM)
            rows[:, :LEFT], rows[:, LEFT + GRAM :] = sides[:, :LEFT], sides[:, LEFT:]
            c = Contexts(rows, one["la"].to_numpy(np.int64), one["ra"].to_numpy(np.int64))
            part, tasks = one["part"].to_numpy(np.int64), []
            for r, (a, b) in enumerate(ranges()):
                tasks.append((np.flatnonzero((part == -1) | (part == r)), a, b))
            low, high = repeated(c, group, n, tasks)
            hit = high >= 0
            yield pd.DataFrame({"g": one["g"].to_numpy()[hit], "ch": one["ch"].to_numpy()[hit], "low": low[hit].astype(np.int32), "high": high[hit].astype(np.int32)})

    dealt = places.where("n > 0").select("g", "ch", "n", "part", "la", "ra", "ctx").repartition("g").sortWithinPartitions("g")
    return dealt.mapInPandas(sort, "g long, ch long, low int, high int")


def _cut(text: str | None, spans) -> tuple[int, int, int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if spans is None or not len(spans):
        return len(raw), 0, 0, raw
    kept, removed, n, end = [], 0, 0, 0
    last = -1
    for s, e in sorted((int(x["s"]), int(x["e"])) for x in spans):
        if s > last:
            kept.append(raw[end:s])
            n += 1
            removed += e - s
            end = last = e
        elif e > last:
            removed += e - last
            end = last = e
    kept.append(raw[end:])
    return len(raw), removed, n, b"".join(kept)


def remove_repeats(docs: DataFrame, *, text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (with ``text``: ``kept``,
    the remaining bytes)."""
    docs = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    places = stored(occurrences(docs, settled(anchor_counts(docs))))
    # A context is named by 128 bits: its group's and its own hash.
    found = runs(places).select(F.col("g").alias("r_g"), F.col("ch").alias("r_ch"), "low", "high")
    hits = places.where("key is not null").select("g", "ch", "key", "did", "pos").join(found, (F.col("ch") == F.col("r_ch")) & (F.col("g") == F.col("r_g")))
    spans = settled(
        hits.groupBy("key", "did").agg(F.collect_set(F.struct((F.col("pos") - F.col("high")).alias("s"), (F.col("pos") - F.col("low") + LENGTH).alias("e"))).alias("spans"))
    )  # bounded by a document's own anchors
    # A document whose bit is not set has no span, and its text stays where it is. The bitmap's size is fixed.
    bits = settled(bitmap(spans.select(F.col("key").alias("h"))))
    at = F.pmod(F.shiftrightunsigned("_key", 20), F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.pmod(at, F.lit(32_768)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    rows = docs.withColumn("_key", _key(docs)).withColumn("_did", _did(docs)).withColumn("_bucket", F.floor(at / 32_768))
    rows = rows.join(F.broadcast(bits), F.col("_bucket") == F.col("bucket"), "left").withColumn("_maybe", is_set).drop("bits", "bucket", "_bucket")
    hit = rows.where("_maybe").join(spans.withColumnRenamed("key", "s_key"), (F.col("_key") == F.col("s_key")) & (F.col("_did") == F.col("did")), "left")
    rows = hit.select("doc_id", "text", "spans").unionByName(rows.where("not _maybe").select("doc_id", "text", F.lit(None).cast(SPANS).alias("spans")))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text else ""))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, every in batches:
            got = [_cut(t, s) for t, s in zip(texts, every)]
            out = {
                "n_bytes": [g[0] for g in got], "n_removed": [g[1] for g in got], "n_spans": [g[2] for g in got],
                "kept_sha256": pd.Series([hashlib.sha256(g[3]).hexdigest() for g in got], dtype=object),
            }
            if text:
                out["kept"] = pd.Series([g[3] for g in got], dtype=object)
            yield pd.DataFrame(out)

    return rows.select("doc_id", cut("text", "spans").alias("c")).select("doc_id", "c.*")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
