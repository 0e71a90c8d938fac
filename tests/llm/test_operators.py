"""The dealt operators on small fixtures: brute force, null and empty input, clashing columns, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronofold.llm import components as C
from chronofold.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing, quality_fm, toxicity_kn, url_filter, warc_revisit
from chronofold.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASH = DOCS + ", _id string, row string, sha string, rep long, _hash int, spans int, _gone long, kept boolean"


def tokens(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def prose(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    base = [prose(r, 60, words) for _ in range(6)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(20, 60):
        w = base[i % 3].split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w)))
    out += [(61, None), (62, ""), (63, "One two"), (64, "one  TWO"), (65, "?!"), (66, "a b c d e"), (67, "Ünï ßé 日本 x"), (20, out[6][1]), (None, base[0]), (70, base[5] * 40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", 1, 2, 3, 4, True) for i, t in rows], CLASH).repartition(3)


def test_exact_dedup_equals_brute_force(spark, rows, docs, monkeypatch):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for least in (exact_dedup.HOT_LEAST, 2):  # and with hot texts
        monkeypatch.setattr(exact_dedup, "HOT_LEAST", least)
        got = exact_dedup.exact_dedup(docs, keep="largest").collect()
        assert len(got) == len(rows)
        for r in got:
            same = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
            assert (r.group_size, r.keep_id) == (len(same), max((x for x in same if x is not None), default=None))
        kept = exact_dedup.drop_exact_copies(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)


def test_decontamination_equals_brute_force(spark, rows, docs):
    items = [("a", rows[1][1]), ("b", "TWO"), ("c", None), ("d", "..."), (None, rows[2][1]), ("e", " ".join(rows[1][1].split()[5:20])), ("f", "日本 X")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for item, t in items:
        w = tokens(t)
        for j in range(max(1, len(w) - 9)) if w and item else ():
            windows.setdefault(tuple(w[j : j + 10]), set()).add(item)
    want = []
    for i, t in rows:
        w, hit, found = tokens(t), set(), set()
        for g, its in windows.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found |= its
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for limit in (decontaminate.BROADCAST_CHARS, 0):  # broadcast and shuffled
        decontaminate.BROADCAST_CHARS, before = limit, decontaminate.BROADCAST_CHARS
        got = [tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()]
        decontaminate.BROADCAST_CHARS = before
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert left[1] == "" and left[63] == "one" and left[61] == "" and left[67] == "ünï ßé".replace("ü", "Ü")
    none = decontaminate.decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows)) and decontaminate.decontaminate(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("block,differences", [(jaccard_join.BLOCK, jaccard_join.DIFFERENCES), (4, 3)])  # and in many blocks
def test_jaccard_join_equals_brute_force(spark, rows, docs, monkeypatch, block, differences):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "DIFFERENCES", differences)
    # Rows without an identifier, and with one that another text has, are linked by their texts.
    more = [(None, rows[1][1] + " once more"), (1, " ".join(rows[2][1].split()[:-1])), (None, None)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", 1, 2, 3, 4, True) for i, t in more], CLASH))
    texts = {}
    for i, t in rows + more:
        texts.setdefault(t or "", []).append(i)
    sets = {}
    for t in texts:
        w = tokens(t)
        k = min(5, len(w))
        sets[t] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    links = {a: {b for b in sets if b != a and sets[a] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])} for a in sets}
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want, classes = [], set()
    for t, ids in texts.items():
        reached, todo = {t}, [t]
        while todo:
            new = links[todo.pop()] - reached
            reached |= new
            todo += new
        name = least([i for x in reached for i in texts[x]])
        classes.add(frozenset(reached))
        want += [(i, least(ids), name, len(links[t])) for i in ids]
    got = jaccard_join.jaccard_join(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    rank = lambda t: (least(texts[t]) is None, least(texts[t]) or 0, hashlib.sha256(t.encode()).digest())
    stay = {min(c, key=rank) for c in classes}
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == sorted(
        (i, t) for t in stay for i in texts[t] if i is not None and i == least(texts[t])
    )
    assert jaccard_join.jaccard_join(docs.limit(0)).collect() == [] and jaccard_join.one_of_each(docs.limit(0)).collect() == []


def test_jaccard_levels_of_a_large_group(spark, monkeypatch):
    # Close copies of one text: most pairs are decided by their distances to the centre.
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "DIFFERENCES", 7)
    r = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(1, 12)):
            w[r.randrange(400)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(396)} for t in texts]
    want = {i: sum(len(a & b) * 5 >= 4 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs).collect()
    assert {x.doc_id: x.n_links for x in got} == want and 0 < sum(n < 80 for n in want.values())
    assert {x.class_id for x in got if want[x.doc_id]} == {0}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(C, "HUB_LEAST", 20)
    edges = [(1000 + i, 5) for i in range(80)] + [(i, i + 1) for i in range(2000, 2030)] + [(1003, 2010)] + [(9, 8)]
    edges += [(4000 + i, 3900) for i in range(90)] + [(3900, 3950), (3950, 3960), (3, 3970), (3970, 3960)]  # a hub that is not least
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 8 if n in (8, 9) else 3 if n == 3 or n >= 3900 else 5 for e in edges for n in e}
    path = spark.createDataFrame([(i, i + d) for i in range(300) for d in (1, 2)], "a long, b long")
    assert {r.component for r in C.components(path).collect()} == {0}
    assert C.components(path.limit(0)).collect() == []


def test_mixing_reaches_targets(spark):
    r = random.Random(2)
    data = [(i, "w " * r.randint(0, 30), "en", s, 0) for i, s in enumerate([None, "a", "b", "b", "b", "", "c"] * 60)] + [(3, "w w", "en", "b", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(data, DOCS)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(data) and all(0 <= x.taken <= 3 * x.size for x in got)
    per = {}
    for x in got:
        per.setdefault((x.source_size, x.target), []).append(x.taken)
    assert all(abs(sum(t) - k[1]) <= 31 and k[1] <= 3 * k[0] for k, t in per.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=str)
    assert mixing.mix_sources(docs.limit(0)).collect() == [] and "copies" in mixing.take(docs).columns


def test_revisits(spark):
    rec = "record_id long, url string, capture_time long, kind string, headers map<string,string>, at int, chunk int"
    rows = [
        (1, "http://A.org/x/", 10, "response", {"etag": '"1"', "content-length": "9", "date": "d1"}, 0, 0),
        (2, "https://www.a.org/x#f", 20, "response", {"etag": '"2"', "last-modified": "m"}, 0, 0),
        (3, "https://a.org/x?utm_a=1", 20, "revisit", {"etag": 'W/"1"', "date": "d3", "content-length": "0"}, 0, 0),
        (4, "https://a.org/x", 30, "revisit", {"last-modified": "m"}, 0, 0),
        (5, "https://a.org/x", 31, "revisit", {"etag": '"9"'}, 0, 0),
        (6, None, 31, "revisit", None, 0, 0), (7, "https://b.org", 5, "revisit", None, 0, 0), (8, "https://a.org/x", None, "revisit", None, 0, 0),
    ]
    got = {r.record_id: r for r in warc_revisit.resolve_revisits(spark.createDataFrame(rows, rec)).collect()}
    assert {i: (r.response_id, r.status) for i, r in got.items()} == {
        3: (1, "resolved"), 4: (2, "resolved"), 5: (None, "validator_mismatch"), 6: (None, "no_response"), 7: (None, "no_response"), 8: (None, "no_response"),
    }
    assert got[3].headers == {"etag": 'W/"1"', "content-length": "9", "date": "d3"}
    assert warc_revisit.resolve_revisits(spark.createDataFrame([], rec)).collect() == []


def test_url_rules_and_edges(spark, sf):
    urls = ["https://EXAMPLE.org/es/a", "http://sub.example.org/en/1x", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/q", "nope", None, "http://notexample.orgs/es/", "://", "http://ü.net/é?x#y"]
    pages = spark.createDataFrame([(i, u, "h", "p", "s") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, score string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [got[i].rule for i in range(5)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/"]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert all(got[i].rule is None and got[i].verdict in ("allow", "block") for i in range(5, 10))
    assert (got[5].host, got[5].path, got[6].host) == ("", "", "") and (got[9].host, got[9].path) == ("ü.net", "/é")
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_url_model_agrees_with_its_own_rules_on_unseen_urls(spark):
    pages = [(i, f"https://{'good' if i % 2 else 'spam'}{i % 13}.{'com' if i < 400 else 'net'}/{'fr' if i % 2 else 'de'}/{'read' if i % 2 else 'buy-now'}/{i}", "") for i in range(600)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).where("rule is null").collect()
    assert sum((r.verdict == "allow") == (r.page_id % 2 == 1) for r in got) >= 0.95 * len(got) and len(got) == 200


def accuracy(out, labels, label):
    got = out.where("held_out").join(labels, "doc_id").select("predicted", "score", label).collect()
    return sum(r.predicted == r[label] for r in got) / len(got), got


def auc(got, label):
    good, bad = [r.score for r in got if r[label]], [r.score for r in got if not r[label]]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / max(1, len(good) * len(bad))


@pytest.mark.parametrize("make,label,least", [(quality_fm.quality_scores, "quality", 0.9), (toxicity_kn.toxicity_scores, "toxic", 0.9)])
def test_classifiers_on_held_out(spark, make, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = make(docs, labels)
    right, got = accuracy(out, labels, label)
    print(label, right, auc(got, label), len(got))
    assert auc(got, label) >= least and right >= 0.85
    assert make(docs.drop("lang", "source").limit(50), labels).count() == 50


@pytest.mark.parametrize("make", [quality_fm.quality_scores, toxicity_kn.toxicity_scores])
def test_classifiers_take_anything(spark, docs, make):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (21, 1, 1), (22, 0, 0), (99, 1, 1)], LABELS + "")
    for some in (labels, labels.limit(0)):
        got = make(docs, some).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert make(docs.limit(0), labels).collect() == []
    assert quality_fm.drop_low_quality(docs, labels).columns == docs.columns == toxicity_kn.drop_toxic(docs, labels).columns


def test_language_id(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs).where("held_out").join(docs, "doc_id").where("lang_pred <> 'und'").select("lang_pred", "lang").collect()
    right = sum(r.lang_pred == r.lang for r in got) / len(got)
    print("language", right, len(got))
    assert right >= 0.95
    odd = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 2), (3, "123 !", "en", 3), (4, "the cat and the dog " * 3, "en", 4), (6, "der Hund und die Katze " * 3, "de", 5)], "doc_id long, text string, lang string, score int")
    r = {x.doc_id: x for x in language_id.identify(odd).collect()}
    assert [r[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and r[1].score == 0 and 0 <= r[4].score <= 1
    assert {x.lang_pred for x in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).collect() == []


def test_forward_sums_all_segmentations():
    import itertools

    import numpy as np

    pieces = ["a", "b", "ab", "ba", "aba", language_id.MARK, language_id.MARK + "a"]
    p = language_id.probabilities(np.random.default_rng(1).random((len(pieces), 2)))
    got = language_id.log_likelihoods(["abab", "b", "ba"], language_id.Lattice(pieces), p)
    for row, word in zip(got, ["abab", "b", "ba"]):
        w, total = language_id.MARK + word, np.zeros(2)
        for cut in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cut) if c], len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:])]
            if all(x in pieces for x in parts):
                total += np.prod([p[pieces.index(x)] for x in parts], axis=0)
        assert np.allclose(row, np.log(total))


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf).collect() == []
    got = corpus_pipeline.run(spark, sf).collect()
    ids, texts = [r.doc_id for r in got], [r.text for r in got]
    assert len(set(ids)) == len(ids) and len(set(texts)) == len(texts) and all(0 < r.copies <= 3 for r in got)
    known = {r.doc_id for r in quality_fm.quality_scores(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert set(ids) <= known
    kept = spark.createDataFrame([(r.doc_id, r.text) for r in got], "doc_id long, text string")
    assert decontaminate.decontaminate(kept, table(spark, sf, "benchmark")).where("contaminated").count() == 0


def toxicity_of(spark, texts, toxic):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    return [r.score for r in toxicity_kn.toxicity_scores(docs, labels).orderBy("doc_id").collect()]


def test_toxicity_keeps_rare_beginnings(spark):
    # The expression makes up under 1/200,000 of all document-word counts.
    r = random.Random(4)
    common = ["".join(r.choice("aeioulnrst") for _ in range(4)) for _ in range(900)]
    texts = [" ".join(r.sample(common, 600)) for _ in range(900)]
    toxic = [0] * 900
    for i in range(900, 910):  # one of those that counts are made from has it
        rare = i == next(x for x in range(900, 910) if zlib.crc32(str(x).encode()) % 5 > 1)
        texts.append(("zqxjkv " if rare else "") + " ".join(common[:5]))
        toxic.append(1)
    seen = "zqxjkv " + " ".join(common[:5])
    texts += [seen, seen.replace("zqxjkv", "wqxjkv")]  # never seen
    got = toxicity_of(spark, texts, toxic)
    assert got[-2] > got[-1]


def test_toxicity_reads_whole_runs(spark):
    r = random.Random(5)
    start = lambda: "".join(r.choice("abcdefghij") for _ in range(25))
    texts = [start() + "zqxjkv" + start() if i % 2 else start() + start() for i in range(200)]
    toxic = [i % 2 for i in range(200)]
    s = start()
    got = toxicity_of(spark, texts + [s + "zqxjkv" + s, s + "badfec" + s], toxic)
    assert got[-2] > 0.5 > got[-1]


def test_url_model_counts_rows_and_every_context(spark):
    seen = [("aab", True, 5), ("aac", False, 1), ("ab", True, 1)]
    tables = url_filter.train(spark.createDataFrame(seen, "_url string, ok boolean, rows long"))
    counts = {}
    for url, ok, rows in seen:
        s = url_filter.START + url
        for i in range(1, len(s)):
            for k in range(min(i, url_filter.ORDER) + 1):
                n = counts.setdefault(s[i - k : i], {}).setdefault(s[i], [0, 0])
                n[not ok] += rows

    def p(x, c, side):
        back = p(x[1:], c, side) if x else 1 / 97
        here = counts.get(x, {})
        n = sum(v[side] for v in here.values())
        return (here.get(c, [0, 0])[side] + url_filter.PRIOR * back) / (n + url_filter.PRIOR)

    for r in [r for t in tables for r in t.where("c is not null").collect()]:
        assert (r.pa, r.pr) == pytest.approx((p(r.x, r.c, 0), p(r.x, r.c, 1)))
    urls = ["aab", "aac", "zab", "aa", "bbbbbbbaab"]
    got = {r._uid: r.score for r in url_filter.score(spark.createDataFrame(list(enumerate(urls)), "_uid long, _url string"), tables).collect()}
    for i, url in enumerate(urls):
        s = url_filter.START + url
        each = [math.log(p(s[max(0, j - 5) : j], s[j], 0) / p(s[max(0, j - 5) : j], s[j], 1)) for j in range(1, len(s))]
        assert got[i] == pytest.approx(sum(each) / len(each), abs=1e-6)
    # 30,000 contexts of one length, each of them once: under a 20,000th.
    r = random.Random(3)
    many = [("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)), i % 2 == 0, 1) for i in range(1000)]
    last = url_filter.train(spark.createDataFrame(many, "_url string, ok boolean, rows long"))[url_filter.ORDER]
    assert last.where("c is null").count() == len({(url_filter.START + u)[i - 5 : i] for u, _, _ in many for i in range(5, 41)})


def test_url_threshold_counts_rows(spark):
    scored = [(0.1, True, 1), (0.3, False, 1), (0.5, True, 9), (-0.5, False, 1), (0.0, True, 1)]
    level = url_filter.calibrate(spark.createDataFrame(scored, "score double, ok boolean, rows long"))
    assert 0.3 < level <= 0.5


def test_forward_sums_segmentations_over_window_ends(spark):
    import numpy as np

    pieces = ["a", "b", "ab", "ba", "aba", language_id.MARK, language_id.MARK + "a"]
    lattice = language_id.Lattice(pieces)
    p = language_id.probabilities(np.random.default_rng(1).random((len(pieces), 2)))
    words = ["ab" * 45 + "a", "ba" * 11 + "b", "b" * 24, "ab" * 12, "aab" * 17]

    def total(word, q):
        w = language_id.MARK + word
        a = [np.ones(2)]
        for j in range(1, len(w) + 1):
            a.append(sum((a[j - len(x)] * q[i] for i, x in enumerate(pieces) if w[:j].endswith(x)), np.zeros(2)))
        return np.log(a[-1])

    assert np.allclose(language_id.log_likelihoods(words, lattice, p), [total(w, p) for w in words])
    # Expected counts are p times the derivative of the log-likelihood.
    weight, lang = np.array([1.0, 2.0, 1.0, 3.0, 1.0]), np.array([0, 1, 1, 0, 1])
    got = language_id.expected(words, weight, lang, lattice, p)
    for i in range(len(pieces)):
        up, down = p.copy(), p.copy()
        up[i] *= 1 + 1e-5
        down[i] *= 1 - 1e-5
        slope = [(total(w, up) - total(w, down)) / 2e-5 for w in words]
        for c in (0, 1):
            assert np.isclose(got[i, c], sum(x * s[c] for x, s, l in zip(weight, slope, lang) if l == c), rtol=1e-4, atol=1e-6)


def test_toxicity_model_by_hand(spark):
    """The pair model against probabilities written out from the counts."""
    data = [("a b a b c d", 0), ("a b c c c e", 0), ("a b x y a b x y x y", 1), ("p q p q p q p q", 1), ("x b b", 1), (None, 1), ("?!", 0)]
    pairs = toxicity_kn.pair_counts(spark.createDataFrame(data, "text string, label int"))
    n, u = ({}, {}), ({}, {})
    for text, c in data:
        words = (text or "").replace("?!", "").split()
        for v, w in zip([toxicity_kn.START] + words, words):
            n[c][v, w] = n[c].get((v, w), 0) + 1
            u[c][w] = u[c].get(w, 0) + 1
    assert {(r.v, r.w): (r.n0, r.n1) for r in pairs.collect()} == {k: (n[0].get(k, 0), n[1].get(k, 0)) for k in n[0].keys() | n[1].keys()}

    def discount(c):
        one, two = (sum(x == k for x in c.values()) for k in (1, 2))
        return one / (one + 2 * two) if one and two else 0.75

    follow = {w: len({v for c in n for v, x in c if x == w}) for w in u[0].keys() | u[1].keys()}

    def p(c, v, w):
        d = discount(u[c])
        shared = (follow[w] + 1 / (len(follow) + 1)) / (sum(follow.values()) + 1)
        one = (max(u[c].get(w, 0) - d, 0) + d * len(u[c]) * shared) / sum(u[c].values())
        after = {x: k for (y, x), k in n[c].items() if y == v}
        if not v or not after:
            return one
        d = discount(n[c])
        return (max(after.get(w, 0) - d, 0) + d * len(after) * one) / sum(after.values())

    want = {("", w): math.log(p(1, "", w) / p(0, "", w)) for w in u[1]}
    want |= {k: math.log(p(1, *k) / p(0, *k)) for k, x in n[1].items() if n[0].get(k) or x >= toxicity_kn.ALONE}
    got = {(r.v, r.w): r.r / toxicity_kn.UNIT for r in toxicity_kn.ratios(pairs).collect()}
    assert got == pytest.approx(want, abs=1e-8) and ("p", "q") in got and ("x", "b") not in got


def test_toxicity_is_the_same_however_much_is_broadcast(spark, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choice("aeinrst") for _ in range(3)) for _ in range(60)] + ["日本", "z" * 50]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) + (" awful thing" if i % 3 == 0 and i % 4 else "") for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    whole = {x.doc_id: x.score for x in toxicity_kn.toxicity_scores(docs, labels).collect()}
    monkeypatch.setattr(toxicity_kn, "HOT", 15)
    assert {x.doc_id: x.score for x in toxicity_kn.toxicity_scores(docs, labels).collect()} == whole
    assert {x.row.doc_id: x.score for x in toxicity_kn.toxicity_scores(docs, labels, carry=True).collect()} == whole


def test_url_pieces_and_long_urls(spark, monkeypatch):
    urls = [(1, "http://a.org/" + "x" * 1000 + "/ü日b"), (2, "ab"), (3, ""), (4, "q" * 512), (5, "q" * 513)]
    at = url_filter._positions(spark.createDataFrame(urls, "_uid long, _url string"), ["_uid"]).collect()
    want = []
    for i, u in urls:
        s = url_filter.START + u
        want += [(i, s[j], s[max(0, j - url_filter.ORDER) : j]) for j in range(1, len(s))]
    assert sorted(map(tuple, at)) == sorted(want)
    # A URL of a million characters, repeated rows, and URLs that differ outside ASCII only.
    good, bad = "http://www.net/ü/good/read", "http://www.net/日/bad/buy"
    pages = [(i, f"http://h{i}.org/ü/good/read{i}", "") for i in range(40)] + [(100 + i, f"http://h{i}.com/de/日/bad/buy{i}", "") for i in range(40)]
    pages += [(200, "http://long.net/" + "good/" * 200_000, ""), (201, good, ""), (201, good, ""), (202, bad, ""), (203, "http://www.net/ü", ""), (204, "http://www.net/日", "")]
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 50)
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got[200].path) == 1_000_001 and got[200].verdict == "allow"
    assert (got[201].verdict, got[202].verdict) == ("allow", "block") and got[203].score > got[204].score


def test_exact_dedup_splits_one_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 8)
    rows = [(7, "same")] * 300 + [(None, "nameless")] * 200 + [(i, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = exact_dedup.exact_dedup(docs, keep="largest").withColumn("p", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sum(r.p == p for r in got) for p in {r.p for r in got}) < 300
    assert sorted(((r.doc_id, r.group_size) for r in got if r.kept), key=str) == sorted([(7, 300), (None, 200)] + [(i, 1) for i in range(50)], key=str)
    assert all((r.keep_id, r.group_size) == (7, 300) for r in got if r.doc_id == 7 and r.group_size > 1)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted([(7, "same"), (None, "nameless")] + rows[500:], key=str)
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == [] and exact_dedup.drop_exact_copies(docs.limit(0)).columns == docs.columns


def test_revisits_of_a_hot_url_equal_brute_force(spark):
    r = random.Random(12)
    rows = []
    for i in range(400):
        url = "https://hot.org/x" if i % 3 else r.choice([None, "http://a.org", "http://b.org/y"])
        time = 50 if 100 <= i < 260 else r.choice([None, *range(100)])  # a burst at one instant
        rows.append((i, url, time, r.choice(["response", "revisit"]), {"etag": str(i)} if i % 2 else None))
    rows += rows[150:153] * 2
    records = spark.createDataFrame([(*x[:4], None if x[3] == "revisit" else x[4]) for x in rows], "record_id long, url string, capture_time long, kind string, headers map<string,string>")
    key = lambda t: (t is not None, t or 0)
    canon = {None: None, "http://a.org": "https://a.org", "http://b.org/y": "https://b.org/y", "https://hot.org/x": "https://hot.org/x"}
    want = []
    for i, url, t, kind, _ in rows:
        if kind == "revisit":
            before = [(key(x[2]), x[0]) for x in rows if x[3] == "response" and url is not None and x[1] == url and key(x[2]) < key(t)]
            want.append((i, canon[url], max(before)[1] if before else None))
    got = warc_revisit.resolve_revisits(records.repartition(3)).collect()
    assert sorted([(x.record_id, x.canonical, x.response_id) for x in got], key=str) == sorted(want, key=str)


def test_language_of_scripts_outside_the_vocabulary(spark):
    one, two = "ᎠᎡᎢᎣᎤᎥ", "ᓀᓁᓂᓃᓄᓅ"  # two scripts that no piece has
    r = random.Random(6)
    text = lambda s: " ".join("".join(r.choice(s) for _ in range(r.randint(2, 30))) for _ in range(12))
    rows = [(i, text(one if i % 2 else two), "x1" if i % 2 else "x2") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    got = language_id.identify(docs).collect()
    assert len(got) == 63 and all(x.lang_pred == ("x1" if x.doc_id % 2 else "x2") for x in got)


def test_pieces_are_compared_in_full(monkeypatch):
    # A hash under which every string of a length is the same.
    monkeypatch.setattr(language_id, "_hash", lambda p: language_id.np.uint64(len(p)))
    lattice = language_id.Lattice(["a", "bc"])
    monkeypatch.setattr(language_id, "BASE", language_id.np.uint64(0))
    lattice.hashes[:2] = [ord("a"), ord("c")]  # with this base a hash is the last letter's number
    lattice.first[:] = 1
    lattice.second[:] = 0
    _, found = lattice.edges(["abcxc"])
    assert found[2][0].tolist() == [2, 1, 2, 2] and found[1][0].tolist() == [0, 3, 3, 3, 3]


def test_pair_sum_identity():
    import numpy as np

    g = np.random.default_rng(3)
    w, v = g.normal(size=quality_fm.FEATURES), g.normal(size=(quality_fm.FEATURES, quality_fm.RANK))
    docs = [quality_fm.features(t) for t in ("One two, two.", None, "a b c d " * 300, "ünï\n日本 x" * 5)]
    starts = np.cumsum([0] + [len(a) for a, _ in docs])[:-1]
    z, _ = quality_fm.margin((0.3, w, v), np.concatenate([a for a, _ in docs]), np.concatenate([x for _, x in docs]).astype(float), starts)
    for got, (a, x) in zip(z, docs):
        pairs = sum(v[a[i]] @ v[a[j]] * x[i] * x[j] for i in range(len(a)) for j in range(i))
        assert got == pytest.approx(0.3 + w[a] @ x + pairs)


def test_quality_fit_by_bytes_and_odd_labels(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2 if i % 3 else None, 0) for i in range(60)], LABELS)
    more = docs.withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1)).withColumn("predicted", F.lit(None).cast("int"))
    every = quality_fm.quality_scores(more, labels, most_bytes=3_000).collect()  # a share of the labelled features
    assert len(every) == more.count() and all(0 <= r.score <= 1 for r in every)
    assert quality_fm.drop_low_quality(more, labels).columns == more.columns


def test_pipeline_equals_brute_force(spark, rows, tmp_path):
    """All stages but the classifier (which keeps all here) against brute force, on null, repeated and clashing rows."""
    import duckdb

    data = [(i, t, "en", ["a", "b", None][n % 3], 0, "x", 5, "y") for n, (i, t) in enumerate(rows + rows[:2] + [(None, None), (80, " ".join(rows[4][1].split()[3:40]))])]
    schema = DOCS + ", copies string, taken_words int, row string"
    folder = str(tmp_path)
    spark.createDataFrame(data, schema).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(folder + "/labels.parquet")
    bench = [("q1", " ".join(rows[4][1].split()[10:25])), ("q2", "one two three"), ("q3", None)]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(folder + "/benchmark.parquet")
    by_text = {}
    for x in data:
        by_text.setdefault(x[1] or "", []).append(x)
    rank = lambda x: (x[0] is None, x[0] or 0)
    unique = [min(g, key=rank) for g in by_text.values()]
    sets = []
    for x in unique:
        w = tokens(x[1])
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    group = list(range(len(unique)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and len(a & b) * 5 >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    sha = lambda x: hashlib.sha256((x[1] or "").encode()).digest()
    left = [min((x for x, g in zip(unique, group) if g == c), key=lambda x: (*rank(x), sha(x))) for c in set(group)]
    windows = {tuple(w[j : j + 10]) for _, t in bench if (w := tokens(t)) for j in range(max(1, len(w) - 9))}
    dirty = lambda w: any(tuple(w[j : j + len(g)]) == g for g in windows for j in range(len(w) - len(g) + 1))
    left = [x for x in left if not dirty(tokens(x[1]))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(x[0], x[1], x[3]) for x in left])
    want = [(i, taken) for i, _, _, _, taken in con.execute(mixing.ORACLE).fetchall() if taken]
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "taken_words", "copies"]
    assert sorted(((r.doc_id, r.taken_words) for r in got.collect()), key=str) == sorted(want, key=str) and len(want) > 5
