r"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line without spaces at its ends, A-Z lower-cased. A key of at least
``min_chars`` code points that ``min_docs`` documents or more hold loses all its lines.

1. Documents are read once for their distinct keys' 128-bit hashes, which are counted
   (summed in the tasks first, so that a key found everywhere is a few rows).
2. The hashes that reach ``min_docs`` are dealt into shards of about ``SHARD_KEYS``, and
   each shard becomes a minimal perfect hash (levels of bit arrays: a key takes the bit that
   it alone wants at a level, else it goes on to the next), a fingerprint of 64 bits and
   a count for each slot. Rarer hashes drop no line and stay outside; the fingerprint
   tells them apart, so that of 10^12 such lines 10^-7 are expected to be mistaken.
3. Documents are read again and probe the arrays. While these take ``BROADCAST_BYTES`` at
   most, they are broadcast and nothing is shuffled. Beyond that the documents' distinct
   hashes go to the shards instead (a shard with many hits is copied, its probes dealt by
   document), and what was found comes back to the documents by a join.

Defined results: every row is a document, so a repeated row counts as often as it occurs; a
null or empty text is one empty line, which stays; a key without a code point is never
dropped; only ``\n`` ends a line, so a text of any length is split in time in proportion to it
and its lines are held in memory once; an empty table gives an empty result; further
columns are ignored, whatever their names. There are no ties: a line stays or goes by its key alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import settled, stored, table

MIN_DOCS = 10
MIN_CHARS = 1
SHARD_KEYS = 100_000
MAX_SHARDS = 100_000
BROADCAST_BYTES = 64 << 20
PART_PROBES = 2_000_000
HELD = 400_000
BLANK = b" \t\n\x0b\x0c\r"
GAMMA = 1.7


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct 128-bit keys (two arrays of 64 bits) to a slot of its own below n."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits of all levels, each level filled up to whole words
        self.starts = np.cumsum([0, *(-(-s // 64) for s in sizes)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        return (_mixed(a + step) ^ _mixed(b ^ step)) % np.uint64(size)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(a):
            size = max(64, int(GAMMA * len(a)))
            at = cls._at(a, b, len(sizes), size).astype(np.int64)
            wanted = np.bincount(at, minlength=-(-size // 64) * 64)
            words.append(np.packbits(wanted == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = wanted[at] > 1
            a, b = a[left], b[left]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The keys' slots; any slot, or -1, for what is not a key."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, size in enumerate(self.sizes):
            at = self._at(a[left], b[left], level, size)
            word, bit = self.starts[level] + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            got = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[got]] & ((np.uint64(1) << bit[got]) - np.uint64(1))
            out[left[got]] = self.before[word[got]] + np.bitwise_count(below)
            left = left[~got]
        return out


class Shard:
    """A shard's arrays: which hashes it holds, and in how many documents each was found."""

    def __init__(self, sizes, bits: bytes, prints: bytes, counts: bytes):
        self.hash = PerfectHash([int(s) for s in sizes], np.frombuffer(bits, "<u8"))
        self.prints, self.counts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4")

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of documents, 0 for what the shard does not hold."""
        slot = self.hash.slots(a, b)
        return np.where((slot >= 0) & (self.prints[slot] == b), self.counts[slot], 0).astype(np.int64)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _keys(text: bytes, min_chars: int) -> list[bytes]:
    """The lines' keys; those under ``min_chars`` as empty."""
    keys = [x.strip(BLANK) for x in text.lower().split(b"\n")]  # bytes.lower() changes A-Z alone
    return keys if min_chars <= 1 else [k if len(k.decode("utf-8", "replace")) >= min_chars else b"" for k in keys]


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``a, b`` (a key's hash) and ``n``, in how many documents it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(held), [("a", "<i8"), ("b", "<i8")])
            found, n = np.unique(both, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found["a"]), pa.array(found["b"]), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0):
                held += map(xxhash.xxh3_128_digest, {k for k in _keys(text.as_py() or b"", min_chars) if k})
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    each = docs.select(docs["text"].cast("binary").alias("text")).mapInArrow(count, "a long, b long, n long")
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"))


def line_index(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per shard: ``shard, n_shards, hits`` and the arrays ``sizes, bits, prints, counts``."""
    found = settled(line_counts(docs, min_chars).where(F.col("n") >= min_docs))
    n = min(MAX_SHARDS, -(-found.count() // SHARD_KEYS)) or 1

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].to_numpy(np.int64).view(np.uint64), pdf["b"].to_numpy(np.int64).view(np.uint64)
        made = PerfectHash.build(a, b)
        prints, counts = np.zeros(len(a), "<u8"), np.zeros(len(a), "<u4")
        slot = made.slots(a, b)
        prints[slot], counts[slot] = b, np.minimum(pdf["n"].to_numpy(), 0xFFFFFFFF)
        row = (key[0], n, int(pdf["n"].sum()), made.sizes, made.bits.tobytes(), prints.tobytes(), counts.tobytes())
        return pd.DataFrame([row], columns=INDEX_COLUMNS)

    return stored(found.withColumn("shard", F.pmod("a", F.lit(n)).cast("int")).groupBy("shard").applyInPandas(build, INDEX))


INDEX_COLUMNS = ["shard", "n_shards", "hits", "sizes", "bits", "prints", "counts"]
INDEX = "shard int, n_shards int, hits long, sizes array<int>, bits binary, prints binary, counts binary"


def _dropped(text: bytes, keys: list[bytes], counts: np.ndarray) -> tuple[int, int, int, bytes]:
    lines = text.split(b"\n")
    kept = b"\n".join([x for x, k, n in zip(lines, keys, counts) if not (k and n)])
    gone = [n for k, n in zip(keys, counts) if k and n]
    return len(lines), len(gone), max(gone, default=0), kept


RESULT = "doc_id long, n_lines long, n_dropped long, max_docs long, text string"


def _result(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    lines, gone, most, kept = map(list, zip(*rows)) if rows else ([], [], [], [])
    arrays = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (lines, gone, most)), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "max_docs", "text"])


def _probed(docs: DataFrame, index: DataFrame, min_chars: int) -> DataFrame:
    """Documents probe broadcast arrays."""
    shards = docs.sparkSession.sparkContext.broadcast(index.collect())  # of BROADCAST_BYTES at most

    def probe(batches):
        known = {r["shard"]: Shard(r["sizes"], r["bits"], r["prints"], r["counts"]) for r in shards.value}
        n = shards.value[0]["n_shards"] if shards.value else 1
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            keys = [_keys(t, min_chars) for t in texts]
            h = _hashes([k for ks in keys for k in ks])
            counts = np.zeros(len(h), np.int64)
            shard = (h[:, 0].view(np.int64) % n).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                if (one := known.get(int(shard[rows[0]]))) is not None:
                    counts[rows] = one(h[rows, 0], h[rows, 1])
            at, rows, counts = 0, [], counts.tolist()
            for t, ks in zip(texts, keys):
                rows.append(_dropped(t, ks, counts[at : at + len(ks)]))
                at += len(ks)
            yield _result(batch.column(0).to_pylist(), rows)

    return docs.mapInArrow(probe, RESULT)


def _dealt(docs: DataFrame, index: DataFrame, min_chars: int) -> DataFrame:
    """The same where the arrays are too large to broadcast: hashes go to the shards."""
    n = index.select("n_shards").first()["n_shards"]
    parts = index.select("shard", F.ceil(F.col("hits") / PART_PROBES).cast("int").alias("parts"))  # MAX_SHARDS rows at most
    # The one column of text is hashed with its identifier, to find the rows again.
    rows = docs.select("*", F.xxhash64("doc_id", "text").alias("da"), F.xxhash64(F.lit(1), "text", "doc_id").alias("db"))

    def probes(batches):
        for batch in batches:
            hs, at = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = {k for k in _keys(text or b"", min_chars) if k}
                hs += found
                at += [i] * len(found)
            h = _hashes(hs).view(np.int64)
            own = [batch.column(c).to_numpy()[np.array(at, np.int64)] for c in ("da", "db")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, h[:, 0].copy(), h[:, 1].copy())], ["da", "db", "a", "b"])

    each = rows.mapInArrow(probes, "da long, db long, a long, b long").withColumn("shard", F.pmod("a", F.lit(n)).cast("int"))
    each = each.join(F.broadcast(parts), "shard").withColumn("part", F.pmod("da", F.col("parts")).cast("int"))
    arrays = ["sizes", "bits", "prints", "counts"]
    kinds = {f.name: f.dataType for f in index.schema}
    asked = each.select("shard", "part", F.lit(1).alias("kind"), "da", "db", "a", "b", *(F.lit(None).cast(kinds[c]).alias(c) for c in arrays))
    none = [F.lit(None).cast("long").alias(c) for c in ("da", "db", "a", "b")]
    held = index.join(F.broadcast(parts), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), *none, *arrays
    )
    keys = ["shard", "part", "kind"]

    def answer(batches):
        one = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            edges = [-1, *np.flatnonzero(kind == 0).tolist(), len(kind)]
            for here, there in zip(edges[:-1], edges[1:]):
                if here >= 0:
                    one = Shard(*(batch.column(c)[here].as_py() for c in arrays))
                rows = batch.slice(here + 1, there - here - 1)
                if rows.num_rows:
                    a, b = (rows.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("a", "b"))
                    counts = one(a, b)
                    got = rows.filter(pa.array(counts > 0))
                    yield pa.RecordBatch.from_arrays(
                        [*(got.column(c).cast(pa.int64()) for c in ("da", "db", "a", "b")), pa.array(counts[counts > 0])], ["da", "db", "a", "b", "n"]
                    )

    dealt = asked.unionByName(held).repartition("shard", "part").sortWithinPartitions(*keys)
    found = dealt.mapInArrow(answer, "da long, db long, a long, b long, n long")
    of_doc = found.groupBy("da", "db").agg(F.collect_set(F.struct("a", "b", "n")).alias("found"))

    def cut(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                keys = _keys(text or b"", min_chars)
                known = {(x["a"], x["b"]): x["n"] for x in found or ()}
                h = _hashes(keys).view(np.int64).tolist()
                rows.append(_dropped(text or b"", keys, [known.get(tuple(x), 0) for x in h]))
            yield _result(batch.column("doc_id").to_pylist(), rows)

    return rows.join(of_doc, ["da", "db"], "left").select("doc_id", "text", "found").mapInArrow(cut, RESULT)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document ``doc_id, n_lines`` (before dropping), ``n_dropped, max_docs`` (documents of its most
    common dropped line) and ``text``, the lines that stay."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    index = line_index(docs, min_docs, min_chars)
    size = index.agg(F.sum(F.length("bits") + F.length("prints") + F.length("counts")).alias("n")).first()["n"]
    return (_probed if (size or 0) <= BROADCAST_BYTES else _dealt)(rows, index, min_chars)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), "max_docs")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), c AS (SELECT key, count(DISTINCT r) AS n FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(n) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (n IS NULL), '')) AS kept_sha256,
       coalesce(max(n), 0) AS max_docs
FROM k LEFT JOIN c USING (key) GROUP BY r
"""
