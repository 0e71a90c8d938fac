"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its distinct words hashed to ``WORD_BUCKETS`` (weights fall
with the number of words, so that they sum to one in square), and one feature for the
bin of each structure statistic (case, punctuation, digits, line and word repetition,
...) and of the metadata that is no label: the length. The score is the logistic of a bias, linear weights
and all pairwise interactions through ``RANK`` factors, computed in time linear in the
features by the identity  sum_{i<j} <v_i,v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

The machine is fitted on at most about ``MAX_TRAIN`` labelled documents, and at most about
``MAX_TRAIN_BYTES`` of their features (chosen by a hash of the identifier, never from the
held-out fold), with mini-batch Adagrad. The features are made by the executors and stored;
the driver gets them as packed bytes. The machine has a fixed number of weights, which are
broadcast. Every whole text is scored.

Defined results: a null text counts as empty and is scored by its statistics alone;
repeated rows get equal scores; where no label is known, or only one value, every
document gets that share as its score (0.5 without labels); an empty table gives an
empty result; further columns are ignored, or returned in ``row`` when ``carry`` is set.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import held_out, stored, table
from chronofold.llm.scoring import labelled

WORD_BUCKETS = 1 << 14
BINS = 16
RANK = 8
MAX_TRAIN = 12_000
MAX_TRAIN_BYTES = 48_000_000
EPOCHS = 8
BATCH = 128
THRESHOLD = 0.3
STATS = (
    "upper", "digit", "punct", "symbol", "space", "newline", "other", "word_len", "distinct",
    "top_word", "repeat_line", "bare_word", "short_line", "n_words", "n_chars",
)
FEATURES = WORD_BUCKETS + len(STATS) * BINS


def statistics(text: str, words: list[str], counts: Counter) -> list[int]:
    """The bin of each statistic of STATS."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    n_words = max(1, len(words))
    upper, digit = raw[65:91].sum(), raw[48:58].sum()
    punct = raw[[33, 34, 39, 44, 46, 58, 59, 63]].sum()
    symbol = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum() - punct
    lines = [x for x in text.split("\n") if x.strip()]
    share = {
        "upper": upper / n * 4, "digit": digit / n * 4, "punct": punct / n * 6, "symbol": symbol / n * 4,
        "space": raw[32] / n * 3, "newline": raw[10] / n * 8, "other": raw[128:].sum() / n * 2,
        "word_len": len(text) / n_words / 20, "distinct": len(counts) / n_words,
        "top_word": (max(counts.values()) if counts else 0) / n_words * 3,
        "repeat_line": 1 - len(set(lines)) / max(1, len(lines)),
        "bare_word": sum(c for w, c in counts.items() if not w[-1].isalnum()) / n_words,
        "short_line": sum(len(x) < 40 for x in lines) / max(1, len(lines)),
        "n_words": np.log2(1 + len(words)) / 18, "n_chars": np.log2(1 + len(text)) / 22,
    }
    return [min(BINS - 1, int(share[s] * BINS)) for s in STATS]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts))
    tf = np.fromiter(counts.values(), np.float64, len(counts))
    value = np.log1p(tf)
    value /= max(1e-9, np.sqrt((value**2).sum()))
    bins = np.asarray(statistics(text, words, counts)) + WORD_BUCKETS + np.arange(len(STATS)) * BINS
    at = np.concatenate([hashed % WORD_BUCKETS, bins]).astype(np.int32)
    return at, np.concatenate([value, np.full(len(STATS), len(STATS) ** -0.5)]).astype(np.float32)


def margin(model: tuple, at: np.ndarray, x: np.ndarray, starts: np.ndarray):
    """Margins of documents whose features lie one after another, and the factor sums."""
    bias, w, v = model
    vx = v[at] * x[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
    return bias + np.add.reduceat(w[at] * x, starts) + pairs, total


def fit(at: list, x: list, y: np.ndarray, *, epochs: int = EPOCHS, rank: int = RANK, seed: int = 7) -> tuple:
    """Mini-batch Adagrad on the logistic loss with a little weight decay."""
    rng = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, rank))
    gw, gv, gb = np.full(FEATURES, 1e-6), np.full((FEATURES, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            a, b = np.concatenate([at[j] for j in batch]), np.concatenate([x[j] for j in batch]).astype(np.float64)
            sizes = np.fromiter((len(at[j]) for j in batch), np.int64, len(batch))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z, total = margin((bias, w, v), a, b, starts)
            g = (1 / (1 + np.exp(-z)) - y[batch]) / len(batch)
            ge = np.repeat(g, sizes) * b
            used, slot = np.unique(a, return_inverse=True)
            dw = np.bincount(slot, ge, len(used)) + 1e-5 * w[used]
            pull = ge[:, None] * (np.repeat(total, sizes, axis=0) - v[a] * b[:, None])
            dv = np.stack([np.bincount(slot, pull[:, k], len(used)) for k in range(rank)], 1) + 1e-5 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            w[used] -= 0.1 * dw / np.sqrt(gw[used])
            v[used] -= 0.05 * dv / np.sqrt(gv[used])
            bias -= 0.1 * g.sum() / np.sqrt(gb)
    return bias, w, v


def packed_features(rows: DataFrame) -> DataFrame:
    """``doc_id, label, at, x`` of rows (``doc_id, text, label``): feature numbers and values as packed bytes."""

    def featurise(batches):
        for pdf in batches:
            made = [features(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "label": pdf["label"], "at": [a.tobytes() for a, _ in made], "x": [x.tobytes() for _, x in made]}
            )

    return rows.mapInPandas(featurise, "doc_id long, label int, at binary, x binary")


def train(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = MAX_TRAIN, most_bytes: int = MAX_TRAIN_BYTES
) -> tuple | float:
    """The fitted machine, or a constant where the labels hold fewer than two values."""
    rows = stored(packed_features(labelled(docs, labels, label, most)))
    size = rows.agg(F.sum(F.length("at") + F.length("x")).alias("n")).first()["n"] or 0
    if size > most_bytes:  # long texts: a smaller share, again by the identifier's hash
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30)) < int(most_bytes / size * (1 << 30)))
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["label"], r["at"], r["x"]))  # about `most_bytes` at most
    y = np.array([r["label"] > 0 for r in got], np.float64)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(r["at"], np.int32) for r in got], [np.frombuffer(r["x"], np.float32) for r in got], y)


def quality_scores(docs: DataFrame, labels: DataFrame, *, carry: bool = False, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` (and ``row``)."""
    model = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            if isinstance(m, float):
                yield pd.Series(np.full(len(texts), m))
                continue
            out = np.zeros(len(texts))
            for i in range(0, len(texts), 256):
                rows = [features(t) for t in texts.iloc[i : i + 256]]
                sizes = np.fromiter((len(r[0]) for r in rows), np.int64, len(rows))
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                z, _ = margin(m, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
                out[i : i + 256] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pd.Series(out)

    out = docs.select(
        docs["doc_id"],
        held_out(docs["doc_id"]).alias("held_out"),
        scored(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("score"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with the columns they had."""
    return quality_scores(docs, labels, carry=True, **options).where(F.col("predicted") == 1).select("row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
