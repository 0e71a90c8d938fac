"""Toxicity: class-conditional Kneser-Ney models of word pairs.

Words are runs of letters, lower-cased; a run of over ``LONGEST`` letters, or one in a
script without spaces, is read letter by letter, each of them a word. A text starts with a
start mark. Each class c (1: toxic, 0: ordinary) has a model with interpolated absolute
discounting,

  P_c(w | v) = (max(n_c(v w) - D, 0) + D t_c(v) P_c(w)) / n_c(v)
  P_c(w)     = (max(n_c(w) - D', 0) + D' T_c P_s(w)) / N_c

with n_c counts of class c, t_c(v) the number of different words it saw after v, T_c that
of its words, N_c that of its tokens, and discounts D = n1 / (n1 + 2 n2) from its numbers
of pairs (words) seen once and twice. P_s is the back-off that both classes share: the
Kneser-Ney continuation counts of all labelled texts (after how many different words a
word occurs). These are the models of ``ratios``. Scores come from ``evidence``, whose pairs
back off to what both classes share as well, scaled by the class's own words:

  P_c(w | v) = (max(n_c(v w) - D, 0) + D t_c(v) P(w | v) P_c(w) / P(w)) / n_c(v)

(that back-off itself where the class never saw v), with P the models of all labelled texts
together. A pair seen once or twice is then close to what its word says, so that none has to
be left out. The scaled back-off is not normalised again. Every pair and word of every
labelled document outside the held-out fold and fold 1 is kept, in partitioned tables that
grow with the input, and is read.

Both models read a token at the same order: as a pair where the labelled texts have it, else
as a word; a word that they do not have gets its back-off. Most words of a toxic text are
ordinary ones, so its likelihood is that of a draw from the toxic model with probability s
and from the ordinary one else; of the shares ``SHARES`` the one whose
log-likelihoods classify the labelled documents of fold 1, which the counts leave out, with
the least log-loss is taken. The two log-likelihoods are divided by the number of words.
Their difference, counted in deviations of ordinary texts from their median and compressed
by the inverse hyperbolic sine (short toxic texts have differences far beyond all others),
becomes a probability by a logistic curve fitted on the same documents (on the counted ones
where fold 1 has one class or none).

Scoring looks the most frequent words and pairs up in a table of about ``HOT`` entries
(twice as many at most, and all words where these are no more than ``HOT``; a word is 128
bits of hash there), which is broadcast. What else
the counts know is joined by 64 bits of hash (of 10^9 pairs known and as many looked up, a
twentieth of one is expected to be mistaken); a bitmap of fixed size says which tokens can be
among it.
Ratios are whole numbers of 1 / ``UNIT``, so results do not depend
on the order of sums or on what is broadcast.

Defined results: a text without letters has a difference of 0; repeated rows get equal
scores; repeated labels count as often as they occur; where only one class is known, or
none, every document scores 0; an empty table gives an empty result; further columns are
ignored, or returned in ``row`` when ``carry`` is set.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import fold, held_out, settled, stored, table
from chronofold.llm.scoring import blocks, labelled, letter_words

SHARES = tuple(2.0**-k for k in range(0, 13, 2))
ALONE = 4
HOT = 2_000_000
FILTER_BITS = 1 << 27
UNIT = 1_000_000_000
LONGEST = 40
# Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
FLUSH = 300_000
CACHED = 400_000
START = "^"
CALIBRATE_ON = 10_000
THRESHOLD = 0.5


def tokens(text: str | None) -> list[str]:
    words = letter_words(text)
    if words and (max(map(len, words)) > LONGEST or not text.isascii() and UNSPACED.search(text)):
        words = [t for w in words for t in (["+" + x for x in w] if len(w) > LONGEST or UNSPACED.search(w) else [w])]
    return words


def pair_counts(rows: DataFrame) -> DataFrame:
    """``v, w, n0, n1``: how often word ``w`` follows ``v`` in all ``rows`` (text, label) of either class."""

    def count(batches):
        both = (Counter(), Counter())
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                words = tokens(text)
                for i in range(0, len(words), FLUSH):
                    both[label > 0].update(zip(words[i - 1 : i] + words[i:] if i else [START, *words], words[i : i + FLUSH]))
                    if len(both[0]) + len(both[1]) > FLUSH:
                        yield out(both)
        yield out(both)

    def out(both):
        # One sorted text column and one number (below 0 for class 1): what is shuffled stays small.
        rows = sorted([(v + " " + w, n) for (v, w), n in both[0].items()] + [(v + " " + w, -n) for (v, w), n in both[1].items()])
        both[0].clear()
        both[1].clear()
        return pd.DataFrame({"p": pd.Series([x[0] for x in rows], dtype=object), "n": np.array([x[1] for x in rows], np.int64)})

    found = rows.select("text", "label").mapInPandas(count, "p string, n long").repartition(F.substring_index("p", " ", 1))
    found = found.select(F.substring_index("p", " ", 1).alias("v"), F.substring_index("p", " ", -1).alias("w"), "n")
    return found.groupBy("v", "w").agg(F.sum(F.greatest("n", F.lit(0))).alias("n0"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("n1"))


def _statistics(counts: DataFrame) -> tuple[list[float], list[int], list[int]]:
    """Per class, and for both together: discount, number of different entries and of tokens."""
    n = [F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")]
    one = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    r = counts.agg(*chain(*[(one(x == 1), one(x == 2), one(x > 0), F.coalesce(F.sum(x), F.lit(0))) for x in n])).first()
    discount = [r[4 * c] / (r[4 * c] + 2 * r[4 * c + 1]) if r[4 * c] and r[4 * c + 1] else 0.75 for c in (0, 1, 2)]
    return discount, [r[4 * c + 2] for c in (0, 1, 2)], [r[4 * c + 3] for c in (0, 1, 2)]


def ratios(pairs: DataFrame) -> DataFrame | None:
    """``v, w, n, r``: what the toxic counts know, with its number of all tokens and, in UNIT, the log-ratio of
    the two models' probabilities. ``v`` is empty for a word by itself. None where a class has no token.
    A part of the pair model's ratios, which scores no longer come from: ``evidence`` has all."""
    words = settled(pairs.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("k")))
    d1, types, total = _statistics(words)
    if not total[0] or not total[1]:
        return None
    d2 = _statistics(pairs)[0]
    shared = words.agg(F.count(F.lit(1)).alias("v"), F.sum("k").alias("s")).first()
    back = (F.col("k") + 1 / (shared["v"] + 1)) / (shared["s"] + 1)
    kept = lambda n, d: F.greatest(n - d, F.lit(0.0))
    p = [(kept(F.col(f"n{c}"), d1[c]) + back * d1[c] * types[c]) / total[c] for c in (0, 1)]
    single = words.where("n1 > 0").select("w", (F.col("n0") + F.col("n1")).alias("n"), p[0].alias("p0"), p[1].alias("p1"))
    contexts = pairs.groupBy("v").agg(*chain(*[(F.sum(f"n{c}").alias(f"s{c}"), F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"t{c}")) for c in (0, 1)]))
    known = pairs.where(F.col("n1") > F.when(F.col("n0") > 0, 0).otherwise(ALONE - 1)).join(contexts, "v").join(single.select("w", "p0", "p1"), "w")
    q = [
        F.when(F.col(f"s{c}") > 0, (kept(F.col(f"n{c}"), d2[c]) + d2[c] * F.col(f"t{c}") * F.col(f"p{c}")) / F.col(f"s{c}")).otherwise(F.col(f"p{c}"))
        for c in (0, 1)
    ]
    r = lambda a, b: F.round((F.log(b) - F.log(a)) * UNIT).cast("long").alias("r")
    return single.select(F.lit("").alias("v"), "w", "n", r(F.col("p0"), F.col("p1"))).unionByName(
        known.select("v", "w", (F.col("n0") + F.col("n1")).alias("n"), r(*q))
    )


def looked_up(single: DataFrame):
    """A function of words that gives their ``p0, p1, p2, f``, from a table of hashes that is broadcast."""

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                numbers = [pdf[c].to_numpy().view(np.uint64)[:, None] for c in ("p0", "p1", "p2", "f")]
                yield pd.DataFrame({"rows": [np.concatenate([hashes(pdf["w"].tolist())[:, :1], *numbers], 1).tobytes()]})

    got = single.mapInPandas(pack, "rows binary").collect()
    every = np.concatenate([np.frombuffer(g["rows"], np.uint64).reshape(-1, 5) for g in got])
    every = every[np.argsort(every[:, 0])]
    if (every[1:, 0] == every[:-1, 0]).any():
        raise RuntimeError("two words have the same 64-bit hash")
    shared = single.sparkSession.sparkContext.broadcast(every)

    @F.pandas_udf("p0 double, p1 double, p2 double, f long")
    def look(words: pd.Series) -> pd.DataFrame:
        number, different = pd.factorize(words)
        rows = shared.value[np.searchsorted(shared.value[:, 0], hashes(different.tolist())[:, 0])[number]] if len(words) else shared.value[:0]
        return pd.DataFrame({c: np.ascontiguousarray(rows[:, i + 1]).view(t) for i, (c, t) in enumerate({"p0": "f8", "p1": "f8", "p2": "f8", "f": "i8"}.items())})

    return look


class Evidence(NamedTuple):
    """Every pair and word of the counts (``v`` is empty for a word by itself)."""

    keys: DataFrame  # v, w, n: with its number of tokens
    table: DataFrame  # v, w, n, r, f: with the log-ratio of the two models' probabilities and that of its back-off, in UNIT
    unknown: int  # the log-ratio of a word that the counts lack
    tokens: int


def evidence(pairs: DataFrame) -> Evidence | None:
    """What the counts ``pairs`` say for either class. None where a class has no token."""
    n = [F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")]
    # With what follows v in all, while the pairs of v are together; sorted, the file is smaller.
    after, sums = Window.partitionBy("v"), {}
    for c in (0, 1, 2):
        sums |= {f"s{c}": F.sum(n[c]).over(after), f"t{c}": F.count(F.when(n[c] > 0, 1)).over(after)}
    pairs = stored(pairs.withColumns(sums).sortWithinPartitions("v", "w"))
    words = stored(pairs.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("k")))
    d1, types, total = _statistics(words)
    if not total[0] or not total[1]:
        return None
    d2 = _statistics(pairs)[0]
    shared = words.agg(F.count(F.lit(1)).alias("v"), F.sum("k").alias("s")).first()
    back = (F.col("k") + 1 / (shared["v"] + 1)) / (shared["s"] + 1)
    kept = lambda n, d: F.greatest(n - d, F.lit(0.0))
    ratio = lambda a, b: F.round((F.log(b) - F.log(a)) * UNIT).cast("long")
    unknown = round((math.log(d1[1] * types[1] / total[1]) - math.log(d1[0] * types[0] / total[0])) * UNIT)
    p = [((kept(n[c], d1[c]) + back * d1[c] * types[c]) / total[c]).alias(f"p{c}") for c in (0, 1, 2)]
    single = words.select("w", n[2].alias("n"), *p).withColumn("f", ratio(F.col("p0"), F.col("p1")))
    small = shared["v"] <= HOT
    known = pairs.withColumn("_w", looked_up(single)("w")).select("*", "_w.*") if small else pairs.join(single.drop("n"), "w")
    both = (kept(n[2], d2[2]) + d2[2] * F.col("t2") * F.col("p2")) / F.col("s2")
    own = [both * F.col(f"p{c}") / F.col("p2") for c in (0, 1)]
    q = [F.when(F.col(f"s{c}") > 0, (kept(n[c], d2[c]) + d2[c] * F.col(f"t{c}") * own[c]) / F.col(f"s{c}")).otherwise(own[c]) for c in (0, 1)]
    alone = single.select(F.lit("").alias("v"), "w", "n", F.col("f").alias("r"), F.lit(unknown).cast("long").alias("f"))
    table = alone.unionByName(known.select("v", "w", n[2].alias("n"), ratio(*q).alias("r"), "f"))
    keys = alone.select("v", "w", "n").unionByName(pairs.select("v", "w", n[2].alias("n")))
    return Evidence(keys, table if small else stored(table), unknown, total[2])


def values(r: np.ndarray, shares: list[float]) -> np.ndarray:
    """Per log-ratio and share, in UNIT, log(1 - s + s ratio)."""
    x, s = np.asarray(r, np.float64)[:, None] / UNIT, np.array(shares)[None, :]
    with np.errstate(divide="ignore"):
        return np.rint(np.logaddexp(np.log1p(-s), np.log(s) + x) * UNIT).astype(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    return h % np.uint64(FILTER_BITS)


def key() -> Column:
    """64 bits of a word or pair, as ``Scorer`` makes them."""
    return F.xxhash64(F.concat_ws(" ", "v", "w"))


def bitmap(rest: DataFrame) -> np.ndarray:
    """A bit per hash ``h`` of ``rest``, of a fixed number, in one piece."""
    at = F.pmod("h", F.lit(FILTER_BITS))
    parts = rest.groupBy(F.floor(at / 32_768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32_768))).alias("bits"))
    out = np.zeros((FILTER_BITS // 32_768, 4_096), np.uint8)
    for row in parts.toLocalIterator():
        out[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


class Scorer:
    """Sums over texts of what is broadcast, and what is left to join: a token that is joined counts as its back-off here."""

    MAYBE, UNKNOWN = -1, -2

    def __init__(self, words: np.ndarray, word_r: np.ndarray, code: np.ndarray, code_r: np.ndarray, bits: np.ndarray | None, unknown: int, shares: list[float]):
        self.words, self.code, self.bits, self.n = words, code, bits, len(words)
        self.index: dict[str, int] = {START: self.n}  # of words that were seen
        self.r, self.shares = np.concatenate([word_r, code_r, [unknown]]), shares

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHED:
            self.index = {START: self.n}
        new = list(set(words).difference(self.index))
        if new:
            h = hashes(new)
            number = np.full(len(new), self.UNKNOWN)
            if self.n:
                slot = np.minimum(np.searchsorted(self.words[:, 0], h[:, 0]), self.n - 1)
                number = np.where((self.words[slot] == h).all(1), slot, number)
            if self.bits is not None:
                other = np.flatnonzero(number < 0)
                number[other[self.may(self.digest([" " + new[i] for i in other.tolist()]))]] = self.MAYBE
            self.index.update(zip(new, number.tolist()))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """Per text: sums, numbers of words, and the hashes of pairs (of words, where only these may be known) to join, with
        how often they occur."""
        docs = [tokens(t) for t in texts]
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = list(chain.from_iterable(chain((START,), d) for d in docs))
        number = self.numbers(flat)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(n + 1) - n - 1] = False  # the start marks
        place = np.flatnonzero(inside)
        w, v = number[place], number[place - 1]
        code = v * (self.n + 1) + w
        found = np.zeros(len(w), bool)
        at = np.where(w >= 0, w, len(self.r) - 1)
        if len(self.code):
            slot = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            found = (v >= 0) & (w >= 0) & (self.code[slot] == code)
            at[found] = self.n + slot[found]
        rest: list = [None] * len(docs)
        if self.bits is not None:
            # A pair that the counts know is one of words that they know.
            pairs = np.flatnonzero(~found & (v != self.UNKNOWN) & (w != self.UNKNOWN))
            h = self.digest([flat[i - 1] + " " + flat[i] for i in place[pairs].tolist()])
            may = self.may(h)
            alone = np.flatnonzero(w == self.MAYBE)
            h = np.concatenate([h[may], self.digest([" " + flat[i] for i in place[alone].tolist()])])
            doc = np.repeat(np.arange(len(docs)), n)[np.concatenate([pairs[may], alone])]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            times, h, doc = np.diff(first, append=len(h)).astype(np.int32), h[first].view(np.int64), doc[first]
            end = np.searchsorted(doc, np.arange(len(docs) + 1))
            rest = [(h[i:j], times[i:j]) if i < j else None for i, j in zip(end[:-1].tolist(), end[1:].tolist())]
        total = np.zeros((len(docs), len(self.shares)), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(values(self.r[at], self.shares), (np.cumsum(n) - n)[some], axis=0)
        return total, n, rest

    @staticmethod
    def digest(keys: list[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in keys), np.uint64, len(keys))

    def may(self, h: np.ndarray) -> np.ndarray:
        bit = _bits(h)
        return ((self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def hashes(words: list[str]) -> np.ndarray:
    """128 bits of each word, in two columns."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    out = np.empty((len(raw), 2), np.uint64)
    for i in (0, 1):
        out[:, i] = np.fromiter((xxhash.xxh64_intdigest(w, 42 + i) for w in raw), np.uint64, len(raw))
    return out


def packed(table: DataFrame, pairs: bool) -> np.ndarray:
    """The rows of ``v, w, r`` on the driver as three numbers each: 128 bits of a word by itself, or 64 of either word of a
    pair, and ``r``; they get there in one row of bytes a batch."""

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                h = hashes(pdf["w"].tolist())
                if pairs:
                    h = np.stack([hashes(pdf["v"].tolist())[:, 0], h[:, 0]], 1)
                yield pd.DataFrame({"rows": [np.concatenate([h, pdf["r"].to_numpy(np.int64).view(np.uint64)[:, None]], 1).tobytes()]})

    got = table.select("v", "w", "r").mapInPandas(pack, "rows binary").collect()
    return np.concatenate([np.zeros((0, 3), np.uint64)] + [np.frombuffer(g["rows"], np.uint64).reshape(-1, 3) for g in got])


class Model:
    """``evidence`` and its frequent part, ready to score with."""

    def __init__(self, known: Evidence):
        keys, table = known.keys, known.table
        self.spark = table.sparkSession
        size, often = keys.count(), F.lit(True)
        if size > HOT:  # about the HOT most frequent; by their share, of which there are no more, if ties make them too many
            often = F.col("n") > keys.agg(F.percentile_approx("n", 1 - HOT / size, 100_000)).first()[0]
            if keys.where(often).count() > 2 * HOT:
                often = F.col("n") * HOT >= known.tokens
            if keys.where("v = ''").count() <= HOT:
                often = often | (F.col("v") == "")
        one = packed(table.where(often & (F.col("v") == "")), False)
        one = one[np.lexsort((one[:, 1], one[:, 0]))]
        if len(one) > 1 and (one[1:, 0] == one[:-1, 0]).any():
            raise RuntimeError("two words have the same 64-bit hash")
        words, word_r = np.ascontiguousarray(one[:, :2]), one[:, 2].astype(np.int64)
        del one
        # The words of a frequent pair are as frequent.
        two = packed(table.where(often & (F.col("v") != "")), True)
        at = lambda h: np.searchsorted(words[:, 0], h)
        code = np.where(two[:, 0] == hashes([START])[0, 0], len(words), at(two[:, 0])).astype(np.int64) * (len(words) + 1) + at(two[:, 1]).astype(np.int64)
        order = np.argsort(code)
        code, code_r = code[order], two[order, 2].astype(np.int64)
        del two, order
        rest = keys.where(~often)
        some = rest.limit(1).count() > 0
        self.rest = table.where(~often).select(key().alias("h"), "r", "f") if some else None
        bits = bitmap(rest.select(key().alias("h"))) if some else None
        self.shared = self.spark.sparkContext.broadcast((words, word_r, code, code_r, bits, known.unknown))

    def among(self, rows: DataFrame) -> DataFrame:
        """The part of ``rest`` that can be among a few ``rows``; their bitmap keeps the others out of the shuffle."""
        shared = self.spark.sparkContext.broadcast(bitmap(rows))

        @F.pandas_udf("boolean")
        def may(at: pd.Series) -> pd.Series:
            bit = at.to_numpy(np.int64)
            return pd.Series((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0)

        return self.rest.where(may(F.pmod("h", F.lit(FILTER_BITS))))

    def sums(self, docs: DataFrame, shares: list[float], few: bool = False) -> DataFrame:
        """``docs`` (with ``_rid`` and ``text``) with ``n``, the number of words, and ``x``, per share the sum of log-ratios in UNIT.
        With ``few`` documents only what they need of the table is shuffled."""
        shared = self.shared

        @F.pandas_udf("x array<long>, n long, h array<long>, times array<int>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(*shared.value, shares)
            for texts in batches:
                every, out = texts.tolist(), []
                for a, b in blocks(every, 1_000_000):
                    total, n, rest = scorer(every[a:b])
                    out.extend((x, k, *(r or (None, None))) for x, k, r in zip(total, n.tolist(), rest))
                yield pd.DataFrame(out, columns=["x", "n", "h", "times"])

        seen = docs.withColumn("_f", score(F.coalesce(docs["text"].cast("string"), F.lit("")))).drop("text")
        more = [c for c in seen.columns if c not in ("_rid", "_f")]
        if self.rest is None:
            return seen.select("_rid", *more, F.col("_f.n").alias("n"), F.col("_f.x").alias("x"))
        each = range(len(shares))
        # A row for the text, which counts nothing in the join and goes where its number says, and one for each token to join.
        seen = seen.select("_rid", "_f.h", "_f.times", F.struct(*more, F.col("_f.n").alias("n"), *[F.col("_f.x")[i].alias(f"x{i}") for i in each]).alias("own"))
        text = F.array(F.struct(F.xxhash64("_rid").alias("h"), F.lit(0).alias("times"), "own"))
        joined = F.transform(F.arrays_zip("h", "times"), lambda t: F.struct(t["h"].alias("h"), t["times"].alias("times"), F.lit(None).cast(seen.schema["own"].dataType).alias("own")))
        rows = seen.select("_rid", F.explode(F.concat(text, F.coalesce(joined, F.filter(text, lambda t: F.lit(False))))).alias("p"))
        rows = rows.select("_rid", "p.h", "p.times", *[F.col(f"p.own.{c}").alias(c) for c in [*more, "n", *[f"x{i}" for i in each]]])
        rows = stored(rows) if few else rows

        @F.pandas_udf("array<long>")
        def further(r: pd.Series, f: pd.Series) -> pd.Series:
            return pd.Series(list(values(r.to_numpy(), shares) - values(f.to_numpy(), shares)))

        known = (self.among(rows.where("times > 0")) if few else self.rest).select(F.col("h").alias("kh"), further("r", "f").alias("y"))
        known = known.select("kh", *[F.col("y")[i].alias(f"y{i}") for i in each])
        rows = rows.join(known, F.col("h") == F.col("kh"), "left").where("times = 0 or kh is not null")  # a false bit finds nothing
        total = [(F.sum(F.coalesce(f"y{i}", F.lit(0)) * F.col("times")) + F.first(f"x{i}", ignorenulls=True)) for i in each]
        return rows.groupBy("_rid").agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*more, "n"]], F.array(*total).alias("x"))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic curve of one feature by Newton steps with a small ridge; the feature is scaled first."""
    scale = float(np.std(x)) or 1.0
    f = np.stack([x / scale, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ b, -30, 30)))
        h = (f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, f.T @ (p - y) + 1e-3 * b), -2, 2)
    return float(b[0] / scale), float(b[1])


class Curve(NamedTuple):
    share: float
    centre: float
    scale: float
    slope: float
    offset: float


def fitted(rows: DataFrame, model: Model) -> Curve | None:
    """The curve with the least log-loss on labelled ``rows``; None if they hold one class or none."""
    rows = rows.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", "label", "text")
    got = model.sums(rows, list(SHARES), few=True).select("label", "n", "x").toPandas()  # about CALIBRATE_ON rows
    y = (got["label"].to_numpy() > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    n = np.maximum(got["n"].to_numpy(np.float64), 1)
    every = np.array(got["x"].tolist(), np.float64) / UNIT / n[:, None]
    best = None
    for i, share in enumerate(SHARES):
        # Sorted, so that sums do not depend on the order of rows.
        order = np.lexsort((y, every[:, i]))
        x, t = every[order, i], y[order]
        centre = float(np.median(x[t == 0]))
        scale = 1.4826 * float(np.median(np.abs(x[t == 0] - centre))) or float(np.std(x)) or 1.0
        f = np.arcsinh((x - centre) / scale)
        slope, offset = calibrate(f, t)
        z = np.clip(slope * f + offset, -50, 50)
        loss = float(np.mean(np.log1p(np.exp(-z)) + (1 - t) * z))
        if best is None or loss < best[0] - 1e-12:
            best = (loss, Curve(share, centre, scale, slope, offset))
    return best[1]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic") -> tuple[Model, Curve] | None:
    """The model and its curve; None where the labels outside the held-out fold do not hold two classes."""
    in_fold_1 = fold(labels["doc_id"]) == 1
    counted = labels.where(~in_fold_1)
    found = evidence(pair_counts(labelled(docs, counted, label)))
    if found is None:
        return None
    model = Model(found)
    curve = fitted(labelled(docs, labels.where(in_fold_1), label, CALIBRATE_ON), model)
    return model, curve or fitted(labelled(docs, counted, label, CALIBRATE_ON), model)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, carry: bool = False, label: str = "toxic") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` (and ``row``)."""
    trained = train(docs, labels, label=label)
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", "text", *row)
    if trained is None:
        out, score = texts, F.lit(0.0)
    else:
        model, c = trained
        out = model.sums(texts, [c.share])
        x = F.col("x")[0] / UNIT / F.greatest(F.col("n"), F.lit(1))
        z = F.asinh((x - c.centre) / c.scale) * c.slope + c.offset
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))
    out = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), *(["row"] if carry else []))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they had."""
    return toxicity_scores(docs, labels, carry=True).where(F.col("predicted") == 0).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
