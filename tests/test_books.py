"""Anchors inside documents, and sections of a spine, against brute force."""

import random
from html.parser import HTMLParser

from chronofold.operators import anchors as H
from chronofold.operators import sections as Z


def split_by_hand(markup, frags):
    """The parts of one document, and whether each boundary was found once."""

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.here, self.parts, self.seen = "", {}, []

        def handle_starttag(self, tag, attrs):
            name = dict(attrs).get("id") or dict(attrs).get("name")
            if name in frags:
                self.here = name
                self.seen.append(name)

        def handle_data(self, data):
            if data.strip():
                self.parts.setdefault(self.here, []).append(data)

    w = Walk()
    w.feed(markup)
    w.close()
    sound = all(w.seen.count(f) == 1 for f in frags if f)
    return sound, {f: " ".join(w.parts.get(f, [])) if sound else "" for f in frags}


def test_anchor_texts_equal_brute_force(spark):
    r = random.Random(8)
    docs, atoms = [], []
    for d in range(60):
        body, names = "", []
        for i in range(r.randint(0, 12)):
            name = r.choice([f"a{i}", f"a{r.randint(0, 12)}"]) if r.random() < 0.6 else None
            names += [name] if name else []
            tag = r.choice(["p", "div", "section", "h2"])
            attr = f' {r.choice(["id", "name"])}="{name}"' if name else ""
            body += f"<{tag}{attr}>t{i} <b>x &amp; y</b>{r.choice(['', ' ', chr(10)])}</{tag}>" + r.choice(["", "tail", "<br/>"])
        docs.append((d, body if d % 9 else f"<html><head><title>no</title></head><body id='top'>{body}</body></html>"))
        frags = {""} | set(r.sample(names, min(len(names), 3))) | ({"absent"} if r.random() < 0.1 else set())
        atoms += [(d, f or r.choice(["", None])) for f in frags]
    docs += [(100, None), (101, ""), (102, "x" * 300_000)]
    atoms += [(100, ""), (101, "a"), (102, "")]
    df = spark.createDataFrame(docs, "doc long, markup string").repartition(3)
    got = H.bucket_by_anchor(H.elements(df), spark.createDataFrame(atoms, "doc long, frag string")).collect()
    want = set()
    for d, markup in docs:
        frags = {f or "" for i, f in atoms if i == d}
        clean = (markup or "").replace("<title>no</title>", "")
        sound, parts = split_by_hand(clean, frags)
        want |= {(d, f, sound, t) for f, t in parts.items()}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert {x.sound for x in got} == {True, False}


def atoms_by_hand(sections, atoms):
    out, taken, claims = {}, set(), {}
    for b, s, h in sections:
        hit = [a for bb, a, ah in atoms if bb == b and ah == h and h]
        out[b, s] = min(hit) if hit else None
        taken |= {(b, min(hit))} if hit else set()
    for b, s, h in sections:
        if out[b, s] is None and h:
            c = [(a, ah) for bb, a, ah in atoms if bb == b and ah and (ah.endswith("/" + h) or h.endswith("/" + ah))]
            if c and len({ah for _, ah in c}) == 1 and (b, min(c)[0]) not in taken:
                claims.setdefault((b, min(c)[0]), []).append((b, s))
    for (b, a), who in claims.items():
        if len(who) == 1:
            out[who[0]] = a
    return out


def test_section_atoms_equal_brute_force(spark):
    r = random.Random(2)
    piece = lambda: r.choice(["text", "OPS", "c1.xhtml", "c2.xhtml", "intro.html", "a"])
    path = lambda: "/".join(piece() for _ in range(r.randint(1, 4)))
    sections = [(b, i, path()) for b in range(12) for i in range(8)] + [(0, 99, ""), (50, 0, "c1.xhtml")]
    atoms = [(b, i, path()) for b in range(12) for i in range(6)] + [(0, 90, ""), (3, 91, "c1.xhtml"), (3, 92, "c1.xhtml")]
    got = Z.section_atoms(spark.createDataFrame(sections, "book long, section long, href string"), spark.createDataFrame(atoms, "book long, atom long, href string")).collect()
    assert {(x.book, x.section): x.atom for x in got} == atoms_by_hand(sections, atoms) and len(got) == len(sections)


def test_suffix_index_forms_no_pairs(spark):
    """A last piece that all paths share costs one row of the index, not a pair for each atom and section."""
    n = 3_000
    paths = spark.range(n).selectExpr("1L AS book", "id", "concat('d', id, '/index.html') AS href")
    got = Z.section_atoms(paths.selectExpr("book", "id AS section", "'index.html' AS href"), paths.selectExpr("book", "id AS atom", "href"))
    assert got.where("atom is not null").count() == 0 and got.count() == n


def test_a_reference_without_its_semicolon_stays(spark):
    df = spark.createDataFrame([(1, "<body>a&amp;b &copy; &amp c &ampx; x&amp")], "doc long, markup string")
    got = H.bucket_by_anchor(H.elements(df), spark.createDataFrame([(1, "")], "doc long, frag string")).collect()
    assert [r.text for r in got] == ["a&b © &amp c &ampx; x&amp"]
