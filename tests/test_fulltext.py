"""Web-style queries and cover density against plain loops."""

import random

from pyspark.sql import functions as F

from chronofold.operators import fulltext as T


def test_parse():
    U = T.Unit
    assert T.parse_web('one "two three" -four OR five-six') == [[U(("one",)), U(("two", "three")), U(("four",), False)], [U(("five", "six"))]]
    assert T.parse_web('-"a b" "open end') == [[U(("a", "b"), False), U(("open", "end"))]]
    assert T.parse_web(' or -- "" ?! or ') == [] and T.parse_web("or a or or b") == [[U(("a",))], [U(("b",))]]


def brute(words, groups):
    """All stretches, shortest ones only."""
    def occurrences(u):
        n = len(u.words)
        return [(i, i + n - 1) for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == u.words]

    wanted = list(dict.fromkeys(u for g in groups for u in g if u.wanted))
    hits = [(s, e) for u in wanted for s, e in occurrences(u)]
    holds = lambda a, b: any((p := [u for u in g if u.wanted]) and all(any(a <= s and e <= b for s, e in occurrences(u)) for u in p) for g in groups)
    covers = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if holds(a, b) and not (a < b and (holds(a + 1, b) or holds(a, b - 1)))]
    score = 0.0
    for a, b in covers:
        n = sum(e - s + 1 for s, e in hits if a <= s and e <= b)
        gap = b - a - (n - 1)
        score += 0.1 / (1 + (gap if gap >= 0 else (n - 1) // 2))
    return score


def test_matches_and_rank(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 14)))) for i in range(60)] + [(60, None), (61, "A, b! C"), (62, "\u00dc b")]
    docs = spark.createDataFrame(rows, "id int, text string").withColumn("w", T.text_words(F.col("text")))
    for query in ("a b", "a", "a b or c d", '"a b" c', '"a b a"', "a -b", "-a", "a b c d e", "", "\u00fc"):
        groups = T.parse_web(query)
        got = docs.select("id", "w", T.matches(F.col("w"), groups).alias("m"), T.rank_cover_density(F.col("w"), groups).alias("s")).collect()
        for x in got:
            has = lambda u: any(tuple(x.w[i : i + len(u.words)]) == u.words for i in range(len(x.w)))
            assert x.m == any(all(has(u) == u.wanted for u in g) for g in groups), (query, x)
            assert abs(x.s - brute(x.w, groups)) < 1e-9, (query, x)


def best_by_hand(n, marked, found, count, least, most):
    """Tries all covers at each turn."""
    left, out = {(s, min(e, s + most - 1)) for s, e in found}, []
    while left and len(out) < count:
        s, e = min(left, key=lambda c: (-len([m for m in marked if c[0] <= m <= c[1]]), c[1] - c[0], c[0]))
        left.discard((s, e))
        taken = {i for a, b in out for i in range(a, b + 1)}
        if taken & set(range(s, e + 1)):
            continue
        room = [i for i in range(n) if i not in taken]
        lo, hi = s, e
        while lo - 1 in room:
            lo -= 1
        while hi + 1 in room:
            hi += 1
        windows = [(a, min(a + most - 1, hi)) for a in range(lo, s + 1) if min(a + most - 1, hi) >= e]
        want = max(lo, s - (most - (e - s + 1)) // 2)
        full = [w for w in windows if w[1] - w[0] + 1 == max(b - a + 1 for a, b in windows)]
        got = min(full, key=lambda w: abs(w[0] - want))
        if got[1] - got[0] + 1 >= least or not out:
            out.append(got)
    return sorted(out)


def test_fragments_equal_brute_force():
    r = random.Random(12)
    for _ in range(400):
        n = r.randint(3, 60)
        words = [r.choice("abxxxxxx") for _ in range(n)]
        groups = T.parse_web(r.choice(["a b", "a", '"a b"', "a or b"]))
        units = T._wanted(groups)
        found = T.covers(T._occurrences(words, units), [[units.index(u) for u in g] for g in groups])
        marked = [i for i, x in enumerate(words) if x in "ab"]
        count, least, most = r.randint(1, 3), r.randint(1, 6), r.randint(6, 14)
        got = T.fragments(n, marked, found, count, least, most)
        assert got == best_by_hand(n, marked, found, count, least, most)
        assert all(a[1] < b[0] for a, b in zip(got, got[1:])) and all(b - a + 1 <= most for a, b in got)


def test_headline(spark):
    docs = spark.createDataFrame([(1, "x " * 50 + "a y b " + "x " * 40), (2, "a " + "x " * 60 + "b a b"), (3, "none")], "id int, text string")
    got = {r.id: r.headline for r in T.search(docs, "a b or none", key="id", limit=5).collect()}
    assert "[a] y [b]" in got[1] and len(got[1].split()) == 36 and got[2].endswith("x [b] [a] [b]") and got[3] == "[none]"
    two = {r.id: r.headline for r in T.search(docs.withColumn("text", F.repeat("text", 2)), "a b", key="id", limit=5, count=2, least=5, most=10, marks=("", "")).collect()}
    assert [p.count("a y b") for p in two[1].split(" ... ")] == [1, 1] and all(len(p.split()) == 10 for p in two[1].split(" ... "))


def test_texts_match_as_their_words_do(spark):
    texts = ["Of the", "of  the!", "often the", "die", "die, edly", "x-of-the-y edly", "", None, "Die Ärzte of", "of of the"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for q in ('"of the" or die -edly', "the -of", "", "-die", '"die ärzte" of'):
        groups = T.parse_web(q)
        rows = df.select(T.text_matches(F.col("text"), groups).alias("a"), T.matches(T.text_words(F.col("text")), groups).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
