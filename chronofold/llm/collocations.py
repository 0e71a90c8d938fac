r"""Phrase collocations by suffix-sigma.

Texts, A-Z lower-cased, are split at ``[.,;:!?\x0A-\x0D]`` into pieces and these at spaces and
tabs into words. A phrase's count is that of all its occurrences within pieces, per language.

1. Words are counted, which tells how many parts the suffixes need and which words begin more of them than a part takes.
2. Every word begins a suffix of at most ``max_n`` words of its piece. Equal suffixes are merged in the tasks and
   shuffled by language and first word: a part is a hash range of these, of about ``PART_WORDS`` suffixes. A frequent first
   word's suffixes are dealt by their whole suffix into parts of their own, so that no task's work follows one
   word. What a task has for a part travels as one row of sorted suffixes.
3. Each part is sorted by suffix in descending order, so that all suffixes with a common prefix follow one another, and
   one stack of prefixes counts all phrases in one reading: what leaves the stack is complete and adds its
   count to what lies below it. A task holds one part at a time.
4. Parts are joined: phrases of split first words are summed over their parts. Only
   phrases whole in their part are held to ``min_count`` before.
5. Candidates (2 to ``max_n`` words) look up the counts of the parts of each of their cuts, lookups of
   frequent words being dealt in as many parts. A candidate inside a longer one of at least ``share`` percent of its
   count goes. The first ``top`` of each language stay, chosen first within hashed parts.

Suffixes end with a space, so that the words' own bytes never disturb the order of prefixes.

Defined results: a null or empty text has no words; a null language is ``und``; a language
without a candidate has no row; every row counts, so a repeated row counts as often as it occurs;
of candidates with equal scores the one with the greater count, then the least phrase
(UTF-8 bytes) comes first; of cuts with equal scores the shortest first part counts; a text of
any length is read whole; an empty table gives an empty result; further columns are ignored, whatever their
names. Arithmetic is in decimals of 38 digits (counts below 10^16); beyond that Spark stops with an error.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain, groupby, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import stored, table

MAX_N = 3
MIN_COUNT = 10
SHARE = 50
TOP = 2_000
PART_WORDS = 500_000
MAX_FREQUENT = 1_000_000
HELD = 400_000
RANK_PARTS = 64
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The word lists of a text's pieces. Of the spaces that ``bytes.split`` knows, pieces hold 0x20 and 0x09 only."""
    for piece in text.lower().translate(ENDS).split(b"\n"):  # bytes.lower() changes A-Z alone
        if words := piece.split():
            yield words


def _counts(batches: Iterator[pa.RecordBatch], of_pieces) -> Iterator[dict[str, Counter]]:
    """By language how often ``of_pieces`` gives what it gives of pieces, in bounded portions: of whole texts where these are short."""
    held: dict[str, Counter] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = pieces(text.as_py())
            while some := list(islice(whole, HELD // 8)):
                found = held.setdefault(lang, Counter())
                before = len(found)
                found.update(of_pieces(some))
                size += len(found) - before
                if size > HELD:
                    yield held
                    held, size = {}, 0
    yield held


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("binary").alias("text"))
    return rows.where(F.length("text") > 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, phrase`` (a word) and ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _counts(batches, chain.from_iterable):
            for lang, found in held.items():
                arrays = [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "n"])

    return _texts(docs).mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _suffixes(max_n: int):
    def of(pieces_: Iterable[list[bytes]]) -> list[bytes]:
        out = []
        for words in pieces_:
            ended = [w + b" " for w in words]
            out += map(b"".join, zip(*(ended[k:] for k in range(max_n))))
            out += [b"".join(ended[-k:]) for k in range(1, min(max_n, len(ended) + 1))]  # the piece's last suffixes are shorter
        return out

    return of


def _part_size(words: DataFrame) -> tuple[int, int]:
    """How many suffixes a part takes, and how many there are: more than ``MAX_FREQUENT`` words cannot exceed a part."""
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    return max(PART_WORDS, total // MAX_FREQUENT), total


def _frequent(words: DataFrame) -> DataFrame:
    """``lang, word, parts`` of the words that begin more suffixes than a part takes, ``MAX_FREQUENT`` at most."""
    most, _ = _part_size(words)
    return words.where(F.col("n") > most).select("lang", F.col("phrase").alias("word"), F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _parted(rows: DataFrame, frequent: DataFrame, word: Column) -> DataFrame:
    """``rows`` with ``parts``, 1 but for frequent words."""
    few = F.broadcast(frequent.select(F.col("lang").alias("_lang"), "word", "parts"))
    rows = rows.withColumn("_word", word)
    joined = rows.join(few, (F.col("lang") == F.col("_lang")) & (F.col("_word") == F.col("word")), "left")
    return joined.withColumn("parts", F.coalesce("parts", F.lit(1))).drop("_lang", "word")


def count_prefixes(suffixes: list[bytes], counts: Mapping[bytes, int], max_n: int, min_count: int, partial: bool = False) -> list[tuple[bytes, int, int]]:
    """``(phrase, size, n)`` of all prefixes found ``min_count`` times; with ``partial`` of all that are shorter than ``max_n`` too.
    ``suffixes`` are in descending order, each word ends with a space. The stack is the last suffix's words and a sum for each."""
    out: list[tuple[bytes, int, int]] = []
    below = max_n if partial else 0
    stack: list[bytes] = []
    sums = [0] * (max_n + 1)
    for s in chain(suffixes, (b" ",)):  # the last one is no suffix's prefix and empties the stack
        words = s[:-1].split(b" ")
        same = 0
        for a, b in zip(stack, words):
            if a != b:
                break
            same += 1
        for size in range(len(stack), same, -1):
            n = sums[size]
            sums[size] = 0
            sums[size - 1] += n
            if n >= min_count or size < below:
                out.append((b" ".join(stack[:size]), size, n))
        stack = words
        sums[len(words)] += counts.get(s, 0)
    return out


def phrase_counts(docs: DataFrame, words: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase, size`` (words) and ``n`` of all phrases found ``min_count`` times or more."""
    most, total = _part_size(words)
    shared = -(-total // most) or 1  # parts of words that are not frequent; a frequent word's own are numbered from here on
    few = {(r["lang"], r["word"].encode()): r["parts"] for r in _frequent(words).collect()}
    frequent = docs.sparkSession.sparkContext.broadcast(few)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = frequent.value
        for held in _counts(batches, _suffixes(max_n)):
            rows: list[tuple] = []
            for lang, found in held.items():
                dealt: defaultdict[int, list[bytes]] = defaultdict(list)
                known: dict[bytes, int] = {}
                start = crc32(lang.encode())
                for s in found:
                    first = s.partition(b" ")[0]
                    if (at := known.get(first)) is None:
                        at = known[first] = -1 if (lang, first) in parts_of else crc32(first, start) % shared
                    if at < 0:
                        at = shared + crc32(b"%d " % (crc32(s) % parts_of[lang, first]) + first, start)
                    dealt[at].append(s)
                for at, some in dealt.items():
                    some.sort(reverse=True)
                    rows.append((at, lang, b"\n".join(some), np.fromiter(map(found.__getitem__, some), "<u4", len(some)).tobytes()))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "lang", "suffixes", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in groupby((r for b in batches for r in zip(*(b.column(c) for c in ("part", "lang", "suffixes", "counts")))), key=lambda r: r[0].as_py()):
            held: defaultdict[str, Counter] = defaultdict(Counter)
            for _, lang, suffixes, counts in group:
                found = held[lang.as_py()]
                for s, n in zip(suffixes.as_py().split(b"\n"), np.frombuffer(counts.as_py(), "<u4").tolist()):
                    found[s] = found.get(s, 0) + n
            for lang, found in held.items():
                # A frequent word's shorter phrases go on into sums over its parts, so none of them may be dropped here.
                out = count_prefixes(sorted(found, reverse=True), found, max_n, min_count, partial=part >= shared)
                if out:
                    phrase, size, n = zip(*out)
                    arrays = [pa.array([lang] * len(out), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "size", "n"])

    dealt = _texts(docs).mapInArrow(deal, "part long, lang string, suffixes binary, counts binary")
    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "lang string, phrase string, size int, n long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _looked_up(rows: DataFrame, counts: DataFrame, frequent: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the count of phrase ``key`` as ``value``; frequent words' counts are copied to their parts."""
    keyed = _parted(rows, frequent, F.col(key)).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.col("parts")).cast("int"))
    held = _parted(counts, frequent, F.col("phrase")).select(
        "lang", F.col("phrase").alias(key), F.col("n").alias(value), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part")
    )
    return keyed.join(held, ["lang", key, "_part"]).drop("_part", "parts", "_word")


def _span(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, cut``: each language's first ``top`` collocations."""
    words = stored(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    counts = stored(phrase_counts(docs, words, max_n, min_count))
    frequent = _frequent(words)
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = found.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _span(F.lit(1), F.col("cut")).alias("first"), _span(F.col("cut") + 1, F.col("size")).alias("rest"))
    cuts = _looked_up(_looked_up(cuts, counts, frequent, "first", "l"), counts, frequent, "rest", "r")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide["a"] * wide["a"]), wide["l"] * wide["r"])
    # The least score, and of its cuts the first.
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("c"))

    # A longer candidate's inner phrases, each with the greatest count of what holds it.
    sizes = F.filter(F.sequence(F.lit(1), F.col("size")), lambda k: (k > 1) & (k < F.col("size")))
    inner = found.where("size > 2").select("lang", "a", "w", "size", F.explode(sizes).alias("k"))
    inner = inner.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    inner = inner.select("lang", "a", _span(F.col("i"), F.col("k")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score", "c.cut", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("_part"))
    near = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    left = left.withColumn("_near", near).where(F.col("_near") <= top)  # so a language's last task gets RANK_PARTS * top rows at most
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = ranked.where(F.col("rank") <= top).join(F.broadcast(totals), "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", F.col("cut").cast("long").alias("cut"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i
  FROM (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p)
), i AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY p ORDER BY i)
), g AS (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM i GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM i WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM i WHERE w3 IS NOT NULL GROUP BY ALL
), t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, size, a, k AS cut, array_to_string(w[1 : k], ' ') AS p1, array_to_string(w[k + 1 :], ' ') AS p2
  FROM c, (VALUES (1), (2)) AS s(k) WHERE k < size
), s AS (
  SELECT cuts.*, g1.f AS l, g2.f AS r, CAST(1000000::HUGEINT * a * a // (g1.f::HUGEINT * g2.f) AS BIGINT) AS score
  FROM cuts JOIN g AS g1 ON g1.lang = cuts.lang AND g1.phrase = p1 AND g1.size = cut
  JOIN g AS g2 ON g2.lang = cuts.lang AND g2.phrase = p2 AND g2.size = cuts.size - cut
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE size = 3
  ) GROUP BY ALL
), k AS (
  SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score,
       CAST(cut AS BIGINT) AS cut
FROM k JOIN t ON t.lang = k.lang QUALIFY rank <= 2000
"""
