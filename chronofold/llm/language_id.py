"""Language identification with segmentation-marginalised unigram models.

Each language has probabilities for the pieces of a fixed public vocabulary, and for the
letters of learnt texts that the vocabulary lacks, each a piece of its own. The
probability of a word is the sum over all its segmentations into pieces, by the forward
algorithm; a text's log-likelihood is the sum over its words (runs of letters,
lower-cased, with the vocabulary's word-start mark). The piece probabilities are learnt
by expectation-maximisation: expected piece counts over all segmentations (forward and
backward sums), from the words of about ``MAX_TRAIN`` documents per language at most,
chosen by a hash of the identifier and never from the held-out fold. The words' counts,
and each round's expected counts, are gathered by Spark; the probabilities (vocabulary
x languages) are broadcast.

The vocabulary file is a parameter; only the driver reads it. Words are read in
windows of ``LONGEST`` letters that carry the sums at the last ends that the longest piece
reaches back to, so pieces over a window's end count and memory is bounded for any text. A
letter that neither the vocabulary nor a learnt text has is equally rare in every language.
Pieces are looked up by hash and compared in full. The model grows with the number of languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text where no language is known; ties go to the first language by name; the score
is the posterior of the predicted language under equal priors, per ``PER_WORDS`` words;
repeated rows get equal results; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import fold, held_out, settled, table
from chronofold.llm.scoring import WordVectors, blocks, letter_words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_TRAIN = 1_500
ROUNDS = 2
LONGEST = 24
UNSEEN = 1e-7
FLOOR = 1e-6
PER_WORDS = 20
MARK = "▁"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(1_000_003)
SLOT_BITS = 21


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The distinct lower-cased letter pieces of the file, with or without the word-start mark."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.replace(MARK, "", 1).isalpha())


def _hash(piece: str) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in piece:
            h = h * BASE + np.uint64(ord(c))
    return h


class Lattice:
    """Piece look-up for many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.hashes = np.array([_hash(p) for p in pieces] + [0], np.uint64)
        with np.errstate(over="ignore"):
            slots = (self.hashes[:-1] * MULTIPLIER) >> np.uint64(64 - SLOT_BITS)
        self.first = np.full(1 << SLOT_BITS, self.n, np.int32)
        self.second = np.full(1 << SLOT_BITS, self.n, np.int32)  # the next piece of the same slot
        self.more: dict[int, int] = {}
        for i, s in enumerate(slots.tolist()):
            if self.first[s] == self.n:
                self.first[s] = i
            elif self.second[s] == self.n:
                self.second[s] = i
            else:
                self.more[int(self.hashes[i])] = i
        if len(np.unique(self.hashes[:-1])) < self.n:
            raise ValueError("two pieces of the vocabulary have the same hash")
        self.lengths = sorted({len(p) for p in pieces})
        self.longest = max(self.lengths, default=1)
        spelt = "".join(p.ljust(self.longest, "\0") for p in pieces).encode("utf-32-le", "surrogatepass")
        self.letters = np.frombuffer(spelt, np.uint32).reshape(self.n, self.longest)

    def edges(self, words: list[str]):
        """Lengths, and per piece length the piece numbers by word and start (``n`` for no piece; ``n + 1``
        for a letter outside the vocabulary)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = flat.reshape(len(words), width).astype(np.uint64)
        prefix = np.zeros((len(words), width + 1), np.uint64)
        found = {}
        with np.errstate(over="ignore"):
            for j in range(width):
                prefix[:, j + 1] = prefix[:, j] * BASE + letters[:, j]
            power = np.uint64(1)
            for k in range(1, min(width, self.longest) + 1):
                power = power * BASE
                if k not in self.lengths and k > 1:
                    continue
                h = prefix[:, k:] - prefix[:, :-k] * power
                slot = (h * MULTIPLIER) >> np.uint64(64 - SLOT_BITS)
                one, two = self.first[slot], self.second[slot]
                at = np.where(self.hashes[one] == h, one, np.where(self.hashes[two] == h, two, self.n)).astype(np.int32)
                for value, i in self.more.items():
                    at[h == np.uint64(value)] = i
                at[np.arange(width - k + 1)[None, :] + k > size[:, None]] = self.n
                word, start = np.nonzero(at < self.n)
                same = (letters[word[:, None], start[:, None] + np.arange(k)] == self.letters[at[word, start], :k]).all(1)
                at[word[~same], start[~same]] = self.n
                if k == 1:
                    inside = np.arange(width)[None, :] < size[:, None]
                    at[(at == self.n) & inside] = self.n + 1
                found[k] = at
        return size, found


def forward(size: np.ndarray, found: dict, p: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Sums over the segmentations of each word's beginnings: word x end x language. ``before`` has the sums
    of the first ends, of the letters that the words share with their windows before."""
    width = int(size.max())
    a = np.zeros((len(size), width + 1, p.shape[1]))
    a[:, 0] = 1.0
    known = 1
    if before is not None:
        known = before.shape[1]
        a[:, :known] = before
    for j in range(known, width + 1):
        for k, at in found.items():
            if k <= j:
                ids = at[:, j - k]
                some = np.flatnonzero(ids != len(p) - 2)
                if len(some):
                    a[some, j] += a[some, j - k] * p[ids[some]]
    return a


def window(w: str, g: int, reach: int) -> str:
    """The ``g``-th LONGEST letters of a marked word, after the letters that pieces over the cut begin in."""
    return w[max(0, g * LONGEST - reach) : (g + 1) * LONGEST]


def log_likelihoods(words: list[str], lattice: Lattice, p: np.ndarray, block: int = 8_192) -> np.ndarray:
    """Word x language. Long words are summed in windows, each with the last sums of the one before."""
    out = np.zeros((len(words), p.shape[1]))
    # Words of about the same length share a block, so that little of it is padding.
    order = sorted(((len(w), i, MARK + w) for i, w in enumerate(words)), key=lambda x: x[0])
    for b in range(0, len(order), block):
        some, g, before = order[b : b + block], 0, None
        while some:
            size, found = lattice.edges([window(x[2], g, lattice.longest) for x in some])
            a = forward(size, found, p, before)
            end = a[np.arange(len(some)), size]
            out[[x[1] for x in some]] += np.log(end)
            g += 1
            more = [n for n, x in enumerate(some) if len(x[2]) > g * LONGEST]
            if more:
                last = int(size[more[0]])
                first = last - min(lattice.longest, g * LONGEST)
                before = a[more, first : last + 1] / end[more][:, None]
            some = [some[n] for n in more]
    return out


def expected(words: list[str], weight: np.ndarray, lang: np.ndarray, lattice: Lattice, p: np.ndarray, block: int = 4_096):
    """Expected piece counts, piece x language, of weighted words of given languages."""
    total = np.zeros_like(p)
    order = sorted((len(w), i, MARK + w) for i, w in enumerate(words))
    for b in range(0, len(order), block):
        some, g, before, steps = order[b : b + block], 0, None, []
        while some:
            who = np.array([x[1] for x in some])
            size, found = lattice.edges([window(x[2], g, lattice.longest) for x in some])
            l, rows, width = lang[who], np.arange(len(some)), int(size.max())
            known = 0 if before is None else before.shape[1] - 1  # letters of the window before
            a = np.zeros((len(some), width + 1))
            a[:, 0] = 1.0
            if before is not None:
                a[:, : known + 1] = before
            for j in range(known + 1, width + 1):
                for k, at in found.items():
                    if k <= j:
                        a[:, j] += a[:, j - k] * p[at[:, j - k], l]
            end = np.maximum(a[rows, size], 1e-300)
            g += 1
            more = np.array([n for n, x in enumerate(some) if len(x[2]) > g * LONGEST], np.int64)
            steps.append((who, size, found, known, a, end, more))
            if len(more):
                last = int(size[more[0]])
                first = last - min(lattice.longest, g * LONGEST)
                before = a[more, first : last + 1] / end[more][:, None]
            some = [some[n] for n in more]
        after = None
        for who, size, found, known, a, end, more in reversed(steps):
            l, rows, width = lang[who], np.arange(len(who)), int(size.max())
            z = np.zeros((len(who), width + 1))
            z[rows, size] = 1 / end
            if after is not None:  # what follows a cut, of the words that go on
                last = int(size[more[0]])
                z[more, last - after.shape[1] + 1 : last + 1] = after / end[more][:, None]
            for j in range(width - 1, -1, -1):
                for k, at in found.items():
                    if known < j + k <= width:
                        z[:, j] += z[:, j + k] * p[at[:, j], l]
            for k, at in found.items():
                for j in range(max(0, known - k + 1), width - k + 1):
                    ids = at[:, j]
                    e = np.flatnonzero(ids < lattice.n)
                    if len(e):
                        np.add.at(total, (ids[e], l[e]), (a[e, j] * p[ids[e], l[e]] * z[e, j + k] * weight[who][e]))
            after = z[:, : known + 1]
    return total


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Piece x language from counts, with the rows for "no piece" (0) and "outside letter"."""
    share = counts / np.maximum(counts.sum(0, keepdims=True), 1e-9)
    mixed = 0.9 * share + 0.1 * share.mean(1, keepdims=True) + FLOOR / max(1, len(counts))
    end = np.zeros((2, counts.shape[1]))
    end[1] = UNSEEN
    return np.concatenate([mixed / mixed.sum(0, keepdims=True), end])


def train(docs: DataFrame, *, path: str = VOCABULARY, most: int = MAX_TRAIN, rounds: int = ROUNDS):
    """``(languages, pieces, probabilities)``; languages is empty where none is known."""
    spark = docs.sparkSession
    known = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & (fold(docs["doc_id"]) != 0))
    sizes = known.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    langs = [r["lang"] for r in sizes]
    pieces = vocabulary(path)
    if not langs:
        return langs, pieces, np.zeros((len(pieces) + 2, 0))
    share = spark.createDataFrame([(r["lang"], i, min(1.0, most / r["count"])) for i, r in enumerate(sizes)], "l string, n int, share double")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(share), known["lang"] == share["l"]).where(unit < F.col("share")).select("n", "text")

    def count(batches):
        for pdf in batches:
            per: dict[int, Counter] = {}
            for n, text in zip(pdf["n"], pdf["text"]):
                per.setdefault(n, Counter()).update(letter_words(text))
            for n, c in per.items():
                yield pd.DataFrame({"n": n, "word": pd.Series(list(c), dtype=object), "rows": list(c.values())})

    words = chosen.mapInPandas(count, "n int, word string, rows long").groupBy("n", "word").agg(F.sum("rows").alias("rows"))
    words = settled(words)
    # The letters that the vocabulary lacks; as many as there are letters at most.
    spelt = words.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c <> ''").collect()
    pieces += sorted({r["c"] for r in spelt}.difference(pieces))
    # The first round starts from one distribution for all: shorter pieces are likelier.
    start = np.array([10.0 ** -len(x) for x in pieces])
    p = probabilities(np.repeat(start[:, None], len(langs), 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, p))

        def counts(batches, shared=shared):
            known_pieces, q = shared.value
            lattice, total = Lattice(known_pieces), None
            for pdf in batches:
                got = expected(pdf["word"].tolist(), pdf["rows"].to_numpy(np.float64), pdf["n"].to_numpy(np.int64), lattice, q)
                total = got if total is None else total + got
            if total is not None:
                at, n = np.nonzero(total)
                yield pd.DataFrame({"piece": at, "n": n, "e": total[at, n]})

        sums = words.mapInPandas(counts, "piece int, n int, e double").groupBy("piece", "n").agg(F.sum("e").alias("e"))
        got = sums.toPandas()  # at most vocabulary x languages rows
        c = np.zeros((len(pieces), len(langs)))
        c[got["piece"], got["n"]] = got["e"]
        p = probabilities(np.round(c, 6))
    return langs, pieces, p


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    langs, pieces, p = train(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast((langs, pieces, p))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, known, q = shared.value
        lattice = Lattice(known)

        def vectors(ws: list[str]) -> np.ndarray:
            return np.concatenate([log_likelihoods(ws, lattice, q), np.ones((len(ws), 1))], 1)

        cache = WordVectors(vectors, len(names) + 1)
        for texts in batches:
            values, out_l, out_s = texts.tolist(), [], []
            for a, b in blocks(values, 500_000):
                words = [letter_words(t) for t in values[a:b]]
                sums = cache.sums(words) if names else np.zeros((b - a, 1))
                for row in sums:
                    if not names or not row[-1]:
                        out_l.append("und")
                        out_s.append(0.0)
                        continue
                    ll = row[:-1] / max(1.0, row[-1] / PER_WORDS)
                    best = int(ll.argmax())
                    out_l.append(names[best])
                    out_s.append(float(1 / np.exp(ll - ll[best]).sum()))
            yield pd.DataFrame({"lang_pred": pd.Series(out_l, dtype=object), "score": out_s})

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    out = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), predicted(text).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
