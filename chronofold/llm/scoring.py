"""What the text scorers share: words of a text, cached vectors of words, training rows."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import fold

LETTERS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 200_000
BROADCAST_LABELS = 4_000_000


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower()) if text else []


class WordVectors:
    """Vectors of distinct words, made in bulk by ``make(list of words) -> array`` and kept for later
    documents of the same task; emptied when it holds more than ``CACHED_WORDS``."""

    def __init__(self, make, width: int):
        self.make, self.width = make, width
        self.index: dict[str, int] = {}
        self.vectors = np.zeros((0, width))

    def sums(self, docs: list[list[str]]) -> np.ndarray:
        """The sum of each document's words' vectors."""
        if len(self.index) > CACHED_WORDS:
            self.index, self.vectors = {}, np.zeros((0, self.width))
        new = list({w for d in docs for w in d}.difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.vectors = np.concatenate([self.vectors, self.make(new)])
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        at = np.fromiter((self.index[w] for d in docs for w in d), np.int64, int(sizes.sum()))
        out = np.zeros((len(docs), self.width))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out[full] = np.add.reduceat(self.vectors[at], starts[full], axis=0)
        return out


def blocks(texts: list, chars: int = 2_000_000):
    """Index ranges of about so many characters, so that a batch of long texts stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """``doc_id, text, label`` of labelled documents outside the held-out fold. With ``most``, about so
    many of them at most, chosen by a hash of the identifier, the same ones in every run.

    Labels without an identifier or a value are left out; of repeated labels of a document each counts.
    """
    known = labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull() & (fold(labels["doc_id"]) != 0))
    known = known.select(labels["doc_id"].alias("l_id"), labels[label].cast("int").alias("label"))
    count = known.count()
    if most is not None and count > most:
        share = int(most / count * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < share)
        count = most
    texts = docs.select(docs["doc_id"], docs["text"])
    side = F.broadcast(known) if count <= BROADCAST_LABELS else known
    return texts.join(side, texts["doc_id"] == known["l_id"]).select("doc_id", "text", "label")
