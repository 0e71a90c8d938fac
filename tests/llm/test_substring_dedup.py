"""Removal of repeated byte strings against brute force, and the suffix arrays against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import substring_dedup as S
from chronofold.llm.lyndon import suffix_arrays

SCHEMA = "doc_id long, text string"


def brute(rows, length=S.LENGTH):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + length] for _, b in texts for j in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edge = np.diff(np.r_[0, gone.astype(int)])
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=9, max_size=9), min_size=1, max_size=5))
def test_suffix_arrays(strings):
    text = np.array([[0, *s] for s in strings], np.int64)
    for row, order in zip(text.tolist(), suffix_arrays(text).tolist()):
        assert order == sorted(range(len(row)), key=lambda i: row[i:])


def corpus():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(90)] + ["süß", "日本"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = prose(60)
    long = prose(150)
    rows = [(1, prose(80) + shared + prose(30)), (2, shared[:200] + prose(20)), (3, "x" + shared[7:260] + "y"), (4, None), (5, ""), (6, long), (7, long)]
    rows += [(8, "ab" * 150), (9, "z" * 199), (10, "z" * 200), (11, "q" * 201), (12, shared[:199])]
    near = long.split(" ")
    for i in range(20, 90):  # near copies, each with some words changed
        w = list(near)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    return [*rows, (1, prose(10)), (6, long), (None, long)]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in S.remove_repeats(df).collect()), key=str)
    assert got == brute(rows)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    raw = np.random.default_rng(3).integers(97, 100, 5_000).astype(np.uint8)
    whole = S.anchors(raw)
    monkeypatch.setattr(S, "BLOCK_BYTES", 700)
    assert all((a == b).all() for a, b in zip(whole, S.anchors(raw)))


def test_hot_anchors_and_large_sets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 5)
    monkeypatch.setattr(S, "HOT_PER_PARTITION", 10_000)
    rows = corpus()
    got = sorted((tuple(r) for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", key string, g int, pos int")
    assert S.remove_repeats(df).collect() == []
    df = spark.createDataFrame([(1, "k" * 300, "a", 1, 2)], SCHEMA + ", key string, g int, pos int")
    assert S.remove_repeats(df, text=True).first()["kept"] == b""


def test_hash_collisions_remove_nothing_else(spark, monkeypatch):
    """With every hash of a context's bytes equal, only what is equal in full is removed."""
    rows = corpus()[:20]
    monkeypatch.setattr(S.Contexts, "hash", lambda self, who, start, end: np.zeros(len(who), np.uint64))
    r = random.Random(3)
    n, width = 40, S.WIDTH
    bytes_ = np.array([[r.randrange(97, 100) for _ in range(width)] for _ in range(n)], np.uint8)
    bytes_[n // 2 :, :] = bytes_[: n // 2, :]  # the second half repeats the first
    bytes_[n // 2 :: 2, 0] = 1  # some of them but for one byte, far left
    c = S.Contexts(bytes_, np.full(n, S.LEFT), np.full(n, S.LENGTH))
    low, high = S.repeated(c, np.zeros(n, np.int64), np.ones(n, np.int64), [(np.arange(n), a, b) for a, b in S.ranges()])
    for i in range(n):
        for o in range(S.OFFSETS) if high[i] >= 0 else ():
            mine = bytes_[i, S.LEFT - o : S.LEFT - o + S.LENGTH]
            same = sum((bytes_[j, S.LEFT - o : S.LEFT - o + S.LENGTH] == mine).all() for j in range(n))
            assert same > 1 or not low[i] <= o <= high[i]


def test_rows_are_told_apart_by_identifier_and_text(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(S, "_key", lambda docs: S.F.lit(7).cast("long") + docs["doc_id"].cast("long") * 0)
    rows = [x for i, x in enumerate(rows) if x[0] is not None and x[0] not in {y[0] for y in rows[:i]}]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in S.remove_repeats(df).collect()), key=str) == brute(rows)


def test_sets_of_many_sizes_share_strings(monkeypatch):
    """Groups of 2 to 20 near contexts: few sorts, and exactly the windows that another context of the group has."""
    r = np.random.default_rng(4)
    rows, group = [], []
    for k in range(2, 21):
        one = r.integers(97, 123, S.WIDTH).astype(np.uint8)
        for _ in range(k):
            other = one.copy()
            for at in r.choice(np.r_[: S.LEFT, S.LEFT + S.GRAM : S.WIDTH], 6):
                other[at] = r.integers(65, 70)
            rows.append(other)
            group.append(k)
    rows, group = np.array(rows), np.array(group)
    sorts, real = [], S.suffix_arrays
    monkeypatch.setattr(S, "suffix_arrays", lambda text: sorts.append(text.shape) or real(text))
    c = S.Contexts(rows, np.full(len(rows), S.LEFT), np.full(len(rows), S.LENGTH))
    low, high = S.repeated(c, group, np.ones(len(rows), np.int64), [(np.arange(len(rows)), a, b) for a, b in S.ranges()])
    for i in range(len(rows)):
        same = [o for o in range(S.OFFSETS) if any((rows[j, S.LEFT - o : S.WIDTH - o] == rows[i, S.LEFT - o : S.WIDTH - o]).all() for j in np.flatnonzero(group == group[i]) if j != i)]
        assert (low[i], high[i]) == ((min(same), max(same)) if same else (S.LENGTH, -1))
    assert 0 < len(sorts) <= len({b - a for a, b in S.ranges()}) * len(S.STRINGS) and (high >= 0).any()
