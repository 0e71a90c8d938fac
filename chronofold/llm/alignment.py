"""Cross-tokenizer alignment by elementary intervals.

A text's tokens of two tokenizers, A and B, cover the same bytes (a space and the text). The
union of both arrays of token ends cuts these into elementary intervals. Each lies in one
token of A and one of B (found by ``searchsorted``) and is their one overlap, so intervals
are links; ends that both have close groups. With ``links="product"`` all token pairs of a
group are linked instead, expanded by ``repeat`` in blocks.

1. Documents are encoded once. What stays of each is written: counts, its groups (or their digest)
   and its distinct linked id pairs with how often each occurs.
2. The pairs are summed over the corpus; there are at most as many as ids of A times ids of B.
3. Each document's pairs look up their corpus-wide counts, and whether these are the highest of the B id. The
   most frequent pairs, at most ``BROADCAST_PAIRS``, are broadcast as sorted arrays; documents' other pairs, none
   of which is frequent, are joined to the rest of the table.

A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` model; their folder is the
parameter ``path``. A's vocabulary runs in ``tiktoken``, which gives the same ids (tests compare all
code points) in a fifth of the time; texts with very long runs of white space, which it
cannot split, are encoded by ``tokenizers`` itself.

Defined results: a text that is null, empty, or not restored exactly by both tokenizers (U+2581, say, is a space to
B) has no tokens: zeros and empty groups; special tokens' strings are plain text; each row is a
document, so repeated rows count in the corpus as often as they occur; of a B id's pairs with equal highest counts
each is highest; texts of any length are encoded whole, in one task each; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import settled, stored, table

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BROADCAST_PAIRS = 2_000_000
TEXTS_AT_ONCE = 64
BLOCK_LINKS = 1_000_000
LONG_BLANK = re.compile(r"\s{1000}")
# Fixed value: how a byte-level vocabulary of this kind splits text into words.
WORDS_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """A tokenizer's ids of texts, and each id's bytes."""

    def __init__(self, encode, tokens: list[bytes], end: bytes):
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        # Each id as text followed by a comma, and after these each id with what ends its group's part: "|" in A, ";" in B.
        self.names = np.array([b"%d%s" % (i, sign) for sign in (b",", end) for i in range(len(tokens))], object)

    def restores(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == text


@lru_cache(maxsize=2)
def sides(path: str) -> tuple[Side, Side]:
    """Both tokenizers; A is given the space, B adds it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(os.path.join(path, FILE_A))
    slow.encode_special_tokens = True
    with open(os.path.join(path, FILE_A), encoding="utf-8") as f:
        special = {t["content"] for t in json.load(f)["added_tokens"]}
    byte = _byte_of_character()
    vocabulary = slow.get_vocab()
    tokens_a = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        tokens_a[i] = piece.encode() if piece in special else bytes(byte[c] for c in piece)
    ranks = {tokens_a[i]: i for piece, i in vocabulary.items() if piece not in special}
    fast = tiktoken.Encoding("a", pat_str=WORDS_A, mergeable_ranks=ranks, special_tokens={})

    def encode_a(texts: list[str]) -> list[list[int]]:
        return [
            slow.encode(t, add_special_tokens=False).ids if LONG_BLANK.search(t) else fast.encode_ordinary(t)
            for t in (" " + t for t in texts)
        ]

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(path, FILE_B))
    tokens_b = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens_b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(encode_a, tokens_a, b"|"), Side(lambda texts: model.encode(texts, num_threads=1), tokens_b, b";")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The owners (token numbers) in A and in B of each elementary interval, and whether it closes a group."""
    ends = np.union1d(ends_a, ends_b)
    left, right = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return left, right, (ends_a[left] == ends) & (ends_b[right] == ends)


def products(up_a: np.ndarray, up_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All token pairs of each group, as blocks of token numbers in A and in B."""
    first_a, first_b = np.r_[0, up_a[:-1]], np.r_[0, up_b[:-1]]
    wide = up_b - first_b
    owner = np.repeat(np.arange(len(up_a)), up_a - first_a)  # the group of each A token
    for_each = np.cumsum(wide[owner])
    cuts = np.searchsorted(for_each, np.arange(BLOCK_LINKS, for_each[-1] + BLOCK_LINKS, BLOCK_LINKS), "right") if len(owner) else []
    at = 0
    for cut in np.unique(np.r_[cuts, len(owner)].astype(np.int64)):
        a = np.arange(at, cut)
        n = wide[owner[a]]
        left = np.repeat(a, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first_b[owner[left]]
        if len(left):
            yield left, right
        at = cut


def groups_text(a: np.ndarray, b: np.ndarray, up_a: np.ndarray, up_b: np.ndarray, one: Side, two: Side) -> bytes:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``. ``up_a`` and ``up_b`` are the numbers of tokens up to each group's end."""
    n_a, n_b = np.diff(up_a, prepend=0), np.diff(up_b, prepend=0)
    out = np.empty(len(a) + len(b), object)
    for ids, up, n, before, side in ((a, up_a, n_a, up_b - n_b, one), (b, up_b, n_b, up_a, two)):
        at = np.arange(len(ids)) + np.repeat(before, n)  # after the other side's tokens of the groups before
        names = ids.copy()
        names[up - 1] += len(side.tokens)
        out[at] = side.names[names]
    return b"".join(out.tolist())[:-1]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<int>"


def encoded(docs: DataFrame, path: str = TOKENIZERS, links: str = "overlap", digest: bool = False) -> DataFrame:
    """Per document its counts, ``groups`` as text (with ``digest`` its SHA-256 in hex) and its distinct pairs of
    linked ids: ``a, b, times``. ``row`` numbers the rows."""
    if links not in ("overlap", "product"):
        raise ValueError(f"links is {links!r}")

    def one_text(text: bytes, ids: tuple[list[int], list[int]], one: Side, two: Side):
        a, b = (np.array(x, np.int64) for x in ids)
        if not (text and one.restores(ids[0], b" " + text) and two.restores(ids[1], b" " + text)):
            return 0, 0, 0, 0, "", [], [], []
        ends_a, ends_b = np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b])
        left, right, closes = intervals(ends_a, ends_b)
        up_a, up_b = left[closes] + 1, right[closes] + 1
        blocks = [(left, right)] if links == "overlap" else products(up_a, up_b)
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for left, right in blocks:
            found, n = np.unique(a[left] * len(two.tokens) + b[right], return_counts=True)
            if len(keys):
                found, at = np.unique(np.r_[keys, found], return_inverse=True)
                n = np.bincount(at, np.r_[times, n]).astype(np.int64)
            keys, times = found, n
        groups = groups_text(a, b, up_a, up_b, one, two)
        groups = hashlib.sha256(groups).hexdigest() if digest else groups.decode()
        return len(a), len(b), len(up_a), int(times.sum()), groups, keys // len(two.tokens), keys % len(two.tokens), times

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(path)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows = [one_text(t.encode(), ids, one, two) for t, *ids in zip(texts, one.encode(texts), two.encode(texts))]
                *counts, groups, a, b, times = map(list, zip(*rows))
                arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.string())]
                starts = pa.array(np.cumsum([0, *map(len, times)]), pa.int32())
                for c in (a, b, times):
                    arrays.append(pa.ListArray.from_arrays(starts, pa.array(np.concatenate(c).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = rows.mapInArrow(encode, ALIGNED.removeprefix("row long, "))
    return out.select(F.monotonically_increasing_id().alias("row"), "*")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, n, best``: corpus-wide counts of linked id pairs; ``best`` if none of the B id's is higher."""
    each = rows.select(F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("p.a", "p.b", F.col("p.times").cast("long").alias("n"))
    counts = settled(each.groupBy("a", "b").agg(F.sum("n").alias("n")))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent_from(counts: DataFrame) -> int:
    """From which count on the pairs are few enough to broadcast."""
    power = F.floor(F.log2("n")).cast("int").alias("power")
    held = 0
    for r in counts.groupBy(power).count().orderBy(F.desc("power")).collect():  # 64 rows at most
        held += r["count"]
        if held > BROADCAST_PAIRS:
            return 2 ** (r["power"] + 1)
    return 0


def align(docs: DataFrame, path: str = TOKENIZERS, links: str = "overlap", digest: bool = False) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``."""
    rows = stored(encoded(docs, path, links, digest))
    counts = settled(pair_counts(rows))
    least = _frequent_from(counts)
    head = counts.where(F.col("n") >= least).toPandas()  # BROADCAST_PAIRS rows at most
    wide = int(head["b"].max()) + 1 if len(head) else 1
    head["key"] = head["a"].astype("int64") * wide + head["b"]
    head = head.sort_values("key")
    frequent = docs.sparkSession.sparkContext.broadcast((head["key"].to_numpy(), head["n"].to_numpy(np.int64), head["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = frequent.value
        for batch in batches:
            ends = np.cumsum([0, *(len(x) for x in batch.column("times"))])
            a, b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times"))
            at = np.minimum(np.searchsorted(keys, a * wide + b), len(keys) - 1)
            got = (keys[at] == a * wide + b) & (b < wide) if len(keys) else np.zeros(len(a), bool)
            at = np.where(got, at, 0)
            sums = [np.r_[0, np.cumsum(np.where(got, v, 0))] for v in ((times * n[at], times * best[at]) if len(keys) else (times * 0, times * 0))]
            rest = pa.array(np.r_[0, np.cumsum(~got)][ends], pa.int32())
            arrays = [
                *(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")),
                *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums[::-1]),
                *(pa.ListArray.from_arrays(rest, pa.array(v[~got].astype(np.int32))) for v in (a, b, times)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, LOOKED_UP)

    shape = ALIGNED.replace("a array<int>", "n_best long, count_sum long, a array<int>")
    found = rows.mapInArrow(look_up, shape)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if least == 0:
        return found.select(*out)
    rare = found.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.a", "p.b", F.col("p.times").cast("long").alias("times"))
    rare = rare.join(counts.where(F.col("n") < least), ["a", "b"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
    )
    joined = found.drop("a", "b", "times").join(rare, "row", "left")
    for column, more in (("n_best", "more_best"), ("count_sum", "more")):
        joined = joined.withColumn(column, F.col(column) + F.coalesce(more, F.lit(0)))
    return joined.select(*out)


LOOKED_UP = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum", "a", "b", "times"]


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
