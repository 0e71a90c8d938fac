"""Line deduplication, collocations and tokenizer alignment on small fixtures: brute force, plans, edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import alignment, collocations, line_dedup

CLASH = "doc_id long, text string, lang string, source string, n_chars long, a long, b int, n string, row string, phrase string, part int, shard int, kind string, da int, groups int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 1, 2, "x", "y", "z", 3, 4, "k", 5, 6) for i, t, lang in rows], CLASH).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    lines = ["Home | About", "  menu\t", "MENU", "Ünï ßé", "\r", "", " ", "\x0b\x0c", "one line", "\x1cx\x1c", "日本 語"]
    out = [(i, "\n".join(r.choice(lines) + ("" if r.random() < 0.8 else str(i)) for _ in range(r.randint(1, 9))), "en") for i in range(60)]
    out += [(100, None, "en"), (101, "", None), (102, "\n", "de"), (103, "x" * 300_000 + "\nmenu\n" + "y\n" * 50_000, "en"), (None, "menu\nHome | About", "en")]
    return out + [(5, out[5][1], "en"), (5, out[5][1], "en")]


def lines_by_hand(rows, min_docs, min_chars):
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t, _ in rows]
    n = Counter(k for ks in keys for k in set(ks))
    gone = {k for k in n if n[k] >= min_docs and len(k) >= min_chars}
    out = []
    for (i, t, _), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if k not in gone]
        out.append((i if i is not None else -1, len(lines), len(lines) - len(kept), max((n[k] for k in ks if k in gone), default=0), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (3, 4)])
@pytest.mark.parametrize("limits", [{}, {"BROADCAST_BYTES": 0, "SHARD_KEYS": 3, "PART_PROBES": 5}])
def test_lines_equal_brute_force(spark, rows, limits, min_docs, min_chars, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(line_dedup, k, v)
    got = line_dedup.drop_common_lines(docs_of(spark, rows), min_docs, min_chars).collect()
    mine = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.max_docs, r.text) for r in got)
    assert mine == lines_by_hand(rows, min_docs, min_chars)


def test_perfect_hash_gives_each_key_its_own_slot():
    g = np.random.default_rng(1)
    for n in (0, 1, 2, 65, 5_000):
        a, b = g.integers(0, 1 << 63, n).astype(np.uint64), g.integers(0, 1 << 63, n).astype(np.uint64)
        a[: n // 2] = 7  # keys that differ in their second half only
        made = line_dedup.PerfectHash.build(a, b)
        assert sorted(made.slots(a, b).tolist()) == list(range(n))
        again = line_dedup.PerfectHash([*made.sizes], np.frombuffer(made.bits.tobytes(), "<u8"))
        assert (again.slots(a, b) == made.slots(a, b)).all()


def test_lines_of_an_empty_table(spark):
    none = spark.createDataFrame([], CLASH)
    assert line_dedup.drop_common_lines(none).count() == 0


def phrases_by_hand(rows, max_n, min_count, share, top):
    f, total = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        found = {p: a for p, a in n.items() if len(p) > 1 and a >= min_count}
        inside = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            s, k = min((1_000_000 * a * a // (n[p[:k]] * n[p[k:]]), k) for k in range(1, len(p)))
            if not (p in inside and 100 * inside[p] >= share * a):
                scored.append((-s, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]], k))
        for rank, (s, a, p, le, r, k) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, total[lang], -s, k))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    r = random.Random(3)
    words = ["the", "of", "New", "york", "city", "\x01x", "a\x1cb", "ünï", "日本", "x" * 300]
    out = [(i, " ".join(r.choice(words) + r.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None])) for i in range(80)]
    return out + [(90, None, "en"), (91, "", "fr"), (92, "the the the " * 20_000, "en"), (93, "new york city. " * 300, "de"), (93, "new york city. " * 300, "de"), (None, "..!", "it")]


@pytest.mark.parametrize("max_n,min_count,top", [(3, 10, 2000), (4, 2, 7)])
@pytest.mark.parametrize("limits", [{}, {"PART_WORDS": 50, "HELD": 40, "RANK_PARTS": 3}])
def test_collocations_equal_brute_force(spark, phrase_rows, limits, max_n, min_count, top, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(collocations, k, v)
    got = collocations.collocations(docs_of(spark, phrase_rows), max_n, min_count, 50, top).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(phrase_rows, max_n, min_count, 50, top)


def test_frequent_first_words_are_parted(spark, phrase_rows, monkeypatch):
    monkeypatch.setattr(collocations, "PART_WORDS", 50)
    words = collocations.word_counts(docs_of(spark, phrase_rows))
    parts = {(r.lang, r.word): r.parts for r in collocations._frequent(words).collect()}
    assert parts["en", "the"] > 10
    rows = spark.createDataFrame([("en", f"the w{i} ") for i in range(1000)], "lang string, phrase string")
    found = collocations._parted(rows, collocations._frequent(words), F.substring_index("phrase", " ", 1))
    assert found.select(F.pmod(F.xxhash64("phrase"), F.col("parts"))).distinct().count() > 10


def test_scores_beyond_64_bits(spark):
    assert spark.sql("SELECT (CAST(1000000 AS decimal(7,0)) * (CAST(900000000000001 AS decimal(19,0)) * CAST(900000000000001 AS decimal(19,0)))) div (CAST(900000000000003 AS decimal(19,0)) * CAST(900000000000007 AS decimal(19,0))) AS s").first().s == 1_000_000 * 900000000000001**2 // (900000000000003 * 900000000000007)


@pytest.fixture(scope="module")
def token_rows():
    r = random.Random(9)
    words = ["Hello", "world", "über", "naïve", "日本語", "🙂👍🏽", "<|endoftext|>", "<s>", "<0x41>", "don't", "  ", "\n\n", "1234567", "\t", "é", "x" * 50, "\x00", "ﬁ", " "]
    out = [(i, "".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randint(1, 40)))) for i in range(60)]
    out += [(70, None), (71, ""), (72, " "), (73, "a▁b"), (74, " " * 5_000 + "x"), (75, "ab " * 30_000), (76, "z" * 100_000), (None, "Hello world"), (77, "Hello world"), (77, "Hello world")]
    return [(i, t, "en") for i, t in out]


def tokens_by_hand(rows, product=False):
    """By the two libraries themselves and by comparing byte ranges; slow."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.FILE_A}")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.FILE_B}")
    byte = alignment._byte_of_character()
    found, n = [], Counter()
    for i, t, _ in rows:
        data = (" " + (t or "")).encode()
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        of_a = [bytes(byte[c] for c in one.id_to_token(x)) for x in a]
        of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := two.id_to_piece(x)) and two.is_byte(x) else p.replace("▁", " ").encode() for x in b]
        if b"".join(of_a) != data or b"".join(of_b) != data:
            a, b, of_a, of_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        starts_a, starts_b = [0, *ends_a], [0, *ends_b]
        links, j, groups, at_a, at_b = [], 0, [], 0, 0
        for k in range(len(a)):
            while j < len(b) and ends_b[j] <= starts_a[k]:
                j += 1
            m = j
            while m < len(b) and starts_b[m] < ends_a[k]:
                links.append((k, m))
                m += 1
        shared = sorted(set(ends_a) & set(ends_b))
        where_a, where_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        every = []
        for e in shared:
            ra, rb = range(at_a, where_a[e] + 1), range(at_b, where_b[e] + 1)
            groups.append((ra, rb))
            every += [(x, y) for x in ra for y in rb] if product else []
            at_a, at_b = where_a[e] + 1, where_b[e] + 1
        text = ";".join(",".join(str(a[x]) for x in ra) + "|" + ",".join(str(b[y]) for y in rb) for ra, rb in groups)
        pairs = [(a[x], b[y]) for x, y in (every if product else links)]
        n.update(pairs)
        found.append((i, len(a), len(b), len(groups), pairs, text))
    most = defaultdict(int)
    for (_, y), k in n.items():
        most[y] = max(most[y], k)
    return sorted((i if i is not None else -1, na, nb, ng, len(p), sum(n[x] == most[x[1]] for x in p), sum(n[x] for x in p), text) for i, na, nb, ng, p, text in found)


@pytest.mark.parametrize("links", ["overlap", "product"])
@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 20, 0])
def test_alignment_equals_brute_force(spark, token_rows, links, most, monkeypatch):
    rows = [r for r in token_rows if links == "overlap" or len(r[1] or "") < 20_000]
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    got = alignment.align(docs_of(spark, rows), links=links).collect()
    mine = sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got)
    assert mine == tokens_by_hand(rows, links == "product")


def test_query_digests_are_of_the_groups(spark, sf, token_rows):
    one = alignment.align(docs_of(spark, token_rows))
    two = alignment.align(docs_of(spark, token_rows), digest=True)
    text = {(r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in one.collect()}
    assert text == {(r.doc_id, r.groups) for r in two.collect()}
    assert "groups_sha256" in alignment.op12_tokenizer_alignment(spark, sf).columns


def test_products_expand_in_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 4)
    up_a, up_b = np.array([1, 4, 6]), np.array([2, 5, 6])
    got = [p for left, right in alignment.products(up_a, up_b) for p in zip(left.tolist(), right.tolist())]
    assert got == [(0, 0), (0, 1), *((x, y) for x in (1, 2, 3) for y in (2, 3, 4)), (4, 5), (5, 5)]


def test_both_engines_of_a_give_the_same_ids_for_every_code_point():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.FILE_A}")
    one, _ = alignment.sides(alignment.TOKENIZERS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c}b\n{c}'s" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    assert [slow.encode(" " + t, add_special_tokens=False).ids for t in texts] == one.encode(texts)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], CLASH)).count() == 0


def test_queries_of_the_round_keep_every_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert line_dedup.op13_line_dedup(spark, sf).count() == n
    assert alignment.op12_tokenizer_alignment(spark, sf).count() == n
