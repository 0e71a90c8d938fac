"""EPUB books as a source: bounded unzipping, package, table of contents and text.

``read`` maps binary files to one row per spine document. The directory's size is checked
before it is parsed, and every member before it is opened; XML with entity declarations is
refused. A book that breaks a bound, or cannot be read, is an error row, not a failed job.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of a book.
MAX_MEMBERS = 4_096
MAX_MEMBER = 32 << 20
MAX_TOTAL = 512 << 20
MAX_RATIO, RATIO_FROM = 200, 1 << 20
MAX_DIRECTORY = 8 << 20
MIMETYPE = b"application/epub+zip"
# The two font obfuscations that are no protection, and what they may cover.
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
GUIDE_TYPES = ("cover", "title-page", "toc", "copyright-page")
MATTER = ("frontmatter", "bodymatter", "backmatter")
FONT_SUFFIXES = (".ttf", ".otf", ".woff", ".woff2")
SCHEMA = "path string, position int, href string, heading string, text string, label string, title string, author string, language string, linear boolean, types array<string>, error string"


class BookError(ValueError):
    pass


def check_directory(content: bytes) -> int:
    """The number of members that the file's end record names; refuses a directory that is too large, in several
    parts or not right before the end record."""
    tail = content[-(22 + 0xFFFF) :]
    at = tail.rfind(b"PK\5\6")
    while at >= 0:
        if at + 22 <= len(tail):
            disk, first, here, members, size, start, comment = struct.unpack_from("<4H2IH", tail, at + 4)
            if at + 22 + comment == len(tail):
                break
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise BookError("no end record")
    if disk or first or here != members or members == 0xFFFF or 0xFFFFFFFF in (size, start):
        raise BookError("several parts or 64-bit records")
    if members > MAX_MEMBERS or size > MAX_DIRECTORY:
        raise BookError("too large")
    if start + size != len(content) - len(tail) + at:
        raise BookError("ambiguous directory")
    return members


def parse_xml(raw: bytes):
    if b"<!ENTITY" in raw.replace(b"\0", b"").upper():
        raise BookError("entity declarations")
    return ElementTree.fromstring(raw)


def check_members(book: zipfile.ZipFile, members: int) -> None:
    infos = book.infolist()
    if len(infos) != members:
        raise BookError("ambiguous directory")
    if sum(i.file_size for i in infos) > MAX_TOTAL:
        raise BookError("too large")
    seen = set()
    for i in infos:
        name = i.filename
        if name.startswith(("/", "\\")) or ".." in name.split("/") or "\\" in name or "\0" in name:
            raise BookError("unsafe name")
        key = unicodedata.normalize("NFC", name.rstrip("/")).casefold()
        if key in seen:
            raise BookError("names collide")
        seen.add(key)
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise BookError("unsupported compression")
        if i.flag_bits & 1 or (i.external_attr >> 16) & 0o170000 == 0o120000:
            raise BookError("encrypted or linked member")
        if i.file_size > MAX_MEMBER or (i.file_size >= RATIO_FROM and i.file_size > MAX_RATIO * max(1, i.compress_size)):
            raise BookError("member too large")
    if "mimetype" in book.namelist() and book.read("mimetype") != MIMETYPE:
        raise BookError("wrong mimetype")


def check_protection(book: zipfile.ZipFile) -> None:
    """Only obfuscated fonts of the book may be listed as encrypted, each by one known algorithm."""
    names = book.namelist()
    for listed in (n for n in names if n.casefold() == "meta-inf/encryption.xml"):
        entries = _elements(parse_xml(book.read(listed)), "EncryptedData")
        if not entries:
            raise BookError("malformed encryption list")
        for data in entries:
            method = [e.get("Algorithm") for e in _elements(data, "EncryptionMethod")]
            target = [posixpath.normpath(e.get("URI", "")) for e in _elements(data, "CipherReference")]
            fonts = target and all(t in names and t.lower().endswith(FONT_SUFFIXES) for t in target)
            if len(method) != 1 or method[0] not in FONT_ALGORITHMS or not fonts:
                raise BookError("protected")


def _elements(root, name: str):
    return [e for e in root.iter() if e.tag.rpartition("}")[2] == name]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.heading, self.skip, self.in_heading = [], [], 0, False
        self.headed = False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.in_heading = tag in ("h1", "h2", "h3") and not self.headed

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        if tag in ("h1", "h2", "h3"):
            self.in_heading, self.headed = False, bool(self.heading)
        if tag in ("p", "div", "h1", "h2", "h3", "li"):
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip <= 0:
            self.parts.append(data)
            if self.in_heading:
                self.heading.append(data)


def html_text(markup: str) -> tuple[str, str]:
    """Body text and first heading."""
    p = _Text()
    p.feed(markup)
    return re.sub(r"[ \t]+", " ", "".join(p.parts)).strip(), " ".join("".join(p.heading).split())


def package(book: zipfile.ZipFile) -> dict:
    """Spine, metadata, landmarks and contents of the package document."""
    roots = _elements(parse_xml(book.read("META-INF/container.xml")), "rootfile")
    if not roots:
        raise BookError("no package")
    path = roots[0].get("full-path", "")
    opf = parse_xml(book.read(path))
    base = posixpath.dirname(path)
    full = lambda href: posixpath.normpath(posixpath.join(base, href.split("#")[0]))
    items = _elements(opf, "item")
    manifest = {e.get("id"): e for e in items}
    if None in manifest or len(manifest) != len(items) or not all(e.get("href") for e in items):
        raise BookError("invalid or repeated manifest item")
    refs = _elements(opf, "itemref")
    if any(r.get("idref") not in manifest for r in refs):
        raise BookError("dangling spine item")
    if not refs:
        raise BookError("empty spine")
    spine = [(full(manifest[r.get("idref")].get("href")), (r.get("linear") or "yes").lower() != "no") for r in refs]
    nav = [i for i, e in manifest.items() if "nav" in (e.get("properties") or "").split()]
    ncx = [i for i, e in manifest.items() if e.get("media-type") == "application/x-dtbncx+xml"] or [s.get("toc") for s in _elements(opf, "spine") if s.get("toc") in manifest]
    place = lambda ids: full(manifest[ids[-1]].get("href")) if ids else None
    guide = [full(e.get("href") or "") for e in _elements(opf, "reference") if (e.get("type") or "").lower() in GUIDE_TYPES]
    meta = lambda name: next((" ".join((e.text or "").split())[:512] for e in _elements(opf, name)), None)
    return {
        "spine": spine, "title": meta("title"), "author": meta("creator"), "language": meta("language"), "version": opf.get("version"),
        "nav": place(nav), "ncx": place(ncx), "guide": sorted(set(guide)), "toc": contents(book, place(nav), place(ncx)),
    }


def _local(node) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def _kids(node, *names: str) -> list:
    return [c for c in node if _local(c) in names]


def _flat(points: list, entry, below, path: tuple[int, ...] = ()) -> Iterator[tuple]:
    """A tree of entries as rows (path, target, label, leaf), parents before children; a point without a target
    lends its place only."""
    for i, point in enumerate(points, 1):
        target, label = entry(point)
        inner = below(point)
        if target:
            yield (*path, i), target, " ".join(label.split()), not inner
        yield from _flat(inner, entry, below, (*path, i))


def _nav_entry(li) -> tuple[str | None, str]:
    links = _kids(li, "a")
    return (links[-1].get("href"), "".join(links[-1].itertext())) if links else (None, "")


def _ncx_entry(point) -> tuple[str | None, str]:
    texts = ["".join(t.itertext()) for label in _kids(point, "navlabel") for t in _kids(label, "text")]
    return next((c.get("src") for c in _kids(point, "content") if c.get("src")), None), next((t for t in texts if t.strip()), "")


def contents(book: zipfile.ZipFile, nav: str | None, ncx: str | None) -> list[tuple]:
    """The table of contents in order: ``(path, href, frag, label, leaf)``, from the navigation document, else from the older table."""
    for name, older in ((nav, False), (ncx, True)):
        if not name or name not in book.namelist():
            continue
        root = parse_xml(book.read(name))
        found: list = []
        if older:
            for points in [e for e in root.iter() if _local(e) == "navmap"][:1]:
                found = list(_flat(_kids(points, "navpoint"), _ncx_entry, lambda p: _kids(p, "navpoint")))
        else:
            for one in (e for e in root.iter() if _local(e) == "nav"):
                kind = next((v for k, v in one.attrib.items() if k.rpartition("}")[2] == "type"), "")
                tops = [li for ol in _kids(one, "ol") for li in _kids(ol, "li")]
                if found or (kind and "toc" not in kind):
                    continue
                found = list(_flat(tops, _nav_entry, lambda li: [x for ol in _kids(li, "ol")[-1:] for x in _kids(ol, "li")]))
        if found:
            base = posixpath.dirname(name)
            split = lambda t: (posixpath.normpath(posixpath.join(base, t.split("#")[0])) if t.split("#")[0] else name, t.partition("#")[2])
            return [(".".join(map(str, path)), *split(target), label, leaf) for path, target, label, leaf in found]
    return []


def first_labels(toc: list[tuple]) -> dict[str, str]:
    """The first label of each file."""
    out: dict[str, str] = {}
    for _, href, _, label, _ in toc:
        out.setdefault(href, label)
    return out


class _Types(HTMLParser):
    """Type tokens of body, section and article elements, in order, up to the first that tells the matter."""

    def __init__(self):
        super().__init__()
        self.found: list[str] = []
        self.told = False

    def handle_starttag(self, tag, attrs):
        if tag.rpartition(":")[2] in ("body", "section", "article") and not self.told:
            for k, v in attrs:
                if k.rpartition(":")[2] == "type":
                    self.found += [t for t in (v or "").lower().split() if t not in self.found]
            self.told = any(t in MATTER for t in self.found)


def type_tokens(markup: str) -> list[str]:
    p = _Types()
    p.feed(markup)
    p.close()
    return p.found


def opened(content: bytes, use) -> list[tuple]:
    """``use(book, package)`` of a book that keeps all bounds; raises what ``FAILURES`` lists."""
    members = check_directory(content)
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        check_members(book, members)
        check_protection(book)
        return use(book, package(book))


FAILURES = (BookError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, zipfile.LargeZipFile, RuntimeError, ValueError, OSError, EOFError, struct.error, zlib.error)


def chapters(path: str, content: bytes) -> list[tuple]:
    def each(book, p) -> list[tuple]:
        labels, out = first_labels(p["toc"]), []
        for n, (href, linear) in enumerate(p["spine"]):
            markup = book.read(href).decode("utf-8", "replace")
            text, heading = html_text(markup)
            out.append((path, n + 1, href, heading, text, labels.get(href), p["title"], p["author"], p["language"], linear, type_tokens(markup), None))
        return out

    try:
        return opened(content, each)
    except FAILURES as e:
        return [(path, 0, *[None] * 9, str(e) or type(e).__name__)]


def _mapped(files: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(path, content)`` of each book. A worker holds a few books at a time, not a batch of thousands."""
    each = F.udf(lambda path, content: rows(path, bytes(content)), f"array<struct<{schema}>>", useArrow=False)
    return files.select(F.explode(each("path", "content")).alias("r")).select("r.*")


def bind(turns: DataFrame, write_one) -> DataFrame:
    """``path, content``: each conversation of ``turns`` (``conv_id, turn, text``) as the book that ``write_one(conv_id, texts
    in order)`` makes."""

    def content(conv, rows) -> bytes:
        return write_one(conv, [r["text"] for r in sorted(rows, key=lambda r: (r["turn"] is None, r["turn"]))])

    each = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("turns"))
    return each.select(F.concat(F.lit("book"), F.col("conv_id").cast("string")).alias("path"), F.udf(content, "binary", useArrow=False)("conv_id", "turns").alias("content"))


def read(files: DataFrame) -> DataFrame:
    """One row per spine document of ``files`` (``path, content``)."""
    return _mapped(files, chapters, SCHEMA)


TOC = "path string, position int, place string, href string, frag string, label string, leaf boolean"
PACKAGE = "path string, title string, author string, language string, version string, nav string, ncx string, guide array<string>, spine int, error string"


def toc(files: DataFrame) -> DataFrame:
    """One row per entry of each book's table of contents, in order; ``place`` is its path in the tree (1.2.1). A book
    that cannot be read has none (``packages`` says why)."""

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            return opened(content, lambda book, p: [(path, n, *entry) for n, entry in enumerate(p["toc"], 1)])
        except FAILURES:
            return []

    return _mapped(files, rows, TOC)


def packages(files: DataFrame) -> DataFrame:
    """One row per book: metadata, version, navigation, older table, guide, length of the spine; or the error."""

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            return opened(content, lambda book, p: [(path, *[p[k] for k in ("title", "author", "language", "version", "nav", "ncx", "guide")], len(p["spine"]), None)])
        except FAILURES as e:
            return [(path, *[None] * 8, str(e) or type(e).__name__)]

    return _mapped(files, rows, PACKAGE)


def landmarks(packages_: DataFrame) -> DataFrame:
    """``path, href, kind``: the navigation documents and what the guides list."""
    nav = packages_.where("nav is not null").select("path", F.col("nav").alias("href"), F.lit("nav").alias("kind"))
    return nav.unionByName(packages_.select("path", F.explode("guide").alias("href"), F.lit("guide").alias("kind")))


def write(docs: list[tuple], title: str = "Book", language: str = "en", more: dict[str, str] | None = None, *, guide: list[str] = (), nav: str | None = None, aside: list[str] = (), toc: list[tuple] | None = None) -> bytes:
    """A small EPUB of (file name, label, heading, body[, type]), for tests and round trips. ``more``: further members;
    ``guide``: file names the guide lists; ``nav``: the name of a navigation document in place of the older table; ``aside``:
    files outside the linear order; ``toc``: its entries (target, label, entries below), else one a file."""
    buffer = io.BytesIO()
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    points = toc if toc is not None else [(d[0], d[1], []) for d in docs]
    listed = lambda ps: "<ol>" + "".join(f'<li><a href="{t}">{esc(n)}</a>{listed(b) if b else ""}</li>' for t, n, b in ps) + "</ol>"
    older = lambda ps: "".join(f'<navPoint><navLabel><text>{esc(n)}</text></navLabel><content src="{t}"/>{older(b)}</navPoint>' for t, n, b in ps)
    table, kind, properties = (nav, "application/xhtml+xml", ' properties="nav"') if nav else ("t.ncx", "application/x-dtbncx+xml", "")
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="{d[0]}" media-type="application/xhtml+xml"/>' for n, d in enumerate(docs) if d[0] != nav)
        refs = "".join(f'<itemref idref="{"toc" if d[0] == nav else f"i{n}"}"{" linear=" + chr(34) + "no" + chr(34) if d[0] in aside else ""}/>' for n, d in enumerate(docs))
        listed_in_guide = "".join(f'<reference type="toc" href="{g}"/>' for g in guide)
        z.writestr("OPS/p.opf", f'<package version="{"3.0" if nav else "2.0"}" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{esc(title)}</dc:title><dc:language>{language}</dc:language></metadata><manifest><item id="toc" href="{table}" media-type="{kind}"{properties}/>{items}</manifest><spine>{refs}</spine><guide>{listed_in_guide}</guide></package>')
        z.writestr(f"OPS/{table}", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc">{listed(points)}</nav></body></html>' if nav else f"<ncx><navMap>{older(points)}</navMap></ncx>")
        for name, _, heading, body, *types in docs:
            if name != nav:
                z.writestr(f"OPS/{name}", f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body{f" epub:type={chr(34)}{types[0]}{chr(34)}" if types else ""}><h1>{esc(heading)}</h1><p>{esc(body)}</p></body></html>')
        for name, body in (more or {}).items():
            z.writestr(name, body)
    return buffer.getvalue()
