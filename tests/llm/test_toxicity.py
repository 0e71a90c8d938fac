"""Every pair and word of the labelled texts is evidence, and every token of a text is scored with it."""

import math
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import toxicity_kn as T

DATA = [("a b a b c d", 0), ("a b c c c e", 0), ("a b x y a b x y x y", 1), ("p q p q p q p q", 1), ("x b b", 1), (None, 1), ("?!", 0)]
TEXTS = ["a b x b", "x b", "d e never a", "c d", "never seen", "p q y a", ""]


def by_hand():
    n = [Counter(), Counter()]
    for text, c in DATA:
        words = (text or "").replace("?!", "").split()
        n[c].update(zip([T.START, *words], words))
    n.append(n[0] + n[1])
    u = [Counter() for _ in n]
    for c in range(3):
        for (_, w), x in n[c].items():
            u[c][w] += x
    follow = Counter(w for _, w in n[2])

    def discount(c):
        one, two = (sum(x == k for x in c.values()) for k in (1, 2))
        return one / (one + 2 * two) if one and two else 0.75

    def word(c, w):
        d, shared = discount(u[c]), (follow[w] + 1 / (len(follow) + 1)) / (sum(follow.values()) + 1)
        return (max(u[c][w] - d, 0) + d * len(u[c]) * shared) / sum(u[c].values())

    def pair(c, v, w, back):
        d, after = discount(n[c]), {x: k for (y, x), k in n[c].items() if y == v}
        return (max(after.get(w, 0) - d, 0) + d * len(after) * back) / sum(after.values()) if after else back

    def ratio(v, w):
        if (v, w) not in n[2]:
            return math.log(word(1, w) / word(0, w))
        both = pair(2, v, w, word(2, w))
        p = [pair(c, v, w, both * word(c, w) / word(2, w)) for c in (0, 1)]
        return math.log(p[1] / p[0])

    return n[2], u[2], ratio


def test_every_pair_and_word_is_evidence(spark):
    pairs, words, ratio = by_hand()
    known = T.evidence(T.pair_counts(spark.createDataFrame(DATA, "text string, label int")))
    got = {(r.v, r.w): (r.n, r.r / T.UNIT) for r in known.table.collect()}
    assert got.keys() == set(pairs) | {("", w) for w in words} and ("x", "b") in got and ("", "d") in got and ("c", "d") in got
    for (v, w), (n, r) in got.items():
        assert n == (pairs[v, w] if v else words[w]) and r == pytest.approx(ratio(v, w), abs=1e-8)
    assert known.unknown / T.UNIT == pytest.approx(ratio("", "never"), abs=1e-8)


@pytest.mark.parametrize("hot", [1000, 12, 3])
@pytest.mark.parametrize("few", [True, False])
def test_every_token_is_scored(spark, monkeypatch, hot, few):
    _, _, ratio = by_hand()
    monkeypatch.setattr(T, "HOT", hot)
    pairs = T.pair_counts(spark.createDataFrame(DATA, "text string, label int"))
    model = T.Model(T.evidence(pairs))
    assert (model.rest is None) == (hot == 1000)
    shares = [0.25, 1.0]
    rows = model.sums(spark.createDataFrame(list(enumerate(TEXTS)), "_rid long, text string"), shares, few).collect()
    for row in rows:
        words = TEXTS[row._rid].split()
        r = np.array([ratio(v, w) for v, w in zip([T.START, *words], words)])
        assert row.n == len(words) and row.x[0] / T.UNIT == pytest.approx(np.log(0.75 + 0.25 * np.exp(r)).sum(), abs=1e-7)
        assert row.x[1] / T.UNIT == pytest.approx(r.sum(), abs=1e-7)
    assert len(rows) == len(TEXTS)
