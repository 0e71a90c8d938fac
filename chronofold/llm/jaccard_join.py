"""N-gram Jaccard join with Bayesian candidate pruning.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are
linked. Equal texts form a class, of which the one with the least identifier takes part.

1. Each text gets ``HASHES`` MinHash values, ``ROWS`` of which make a band; texts that
   share a band are candidates (of pairs at 0.8, 0.9999970 share one of the 32).
2. Candidates' MinHash values are compared 16 at a time. With a uniform prior, the
   similarity after m matches of n has a beta posterior; a pair is dropped as soon as the
   posterior probability of 0.8 or more falls below ``TOLERANCE``. What stays is emitted
   as a spanning forest of each band's group, never as all its pairs: a group is searched
   breadth-first, a text is compared only with those that no edge has reached yet. A band's
   group of more than ``BLOCK`` texts is dealt into blocks, each searched by itself and
   tied to the band's least text: what that joins too much, step 3 takes apart again.
3. The forests' components are the candidate groups, and each text of one is shuffled
   once. A group of at most ``BLOCK`` texts is verified in one task, every pair exactly on
   whole shingle sets (intersections of all pairs at once by a matrix product over the
   shingles that some but not all share). Of a larger group each text is compared with the
   group's centre and only its difference from the centre goes on. Jaccard distance is a
   metric: two texts whose distances to the centre add up to 0.2 at most are linked, two
   whose distances differ by more are not. Such pairs of distance levels are counted, not
   compared; the other pairs are verified exactly, by pairs of blocks of differences.
   Only each text's number of links and a spanning forest leave a task; the components of
   these forests are the classes.

So a hot group of close copies costs time in proportion to its size. A large group of
texts further than 0.1 from their centre is compared pair by pair (as exact numbers of
links ask for), from differences instead of texts. Nothing is capped or dropped. Texts are
told apart by SHA-256, shingles by 64-bit hashes.

Words are the contract's words (see ``common.WORD``), A-Z lower-cased. Defined results: a
text of fewer than five words, but not none, has one shingle of them all; a text without
words has none and no link, nor has a null text (equal ones still share a class); a row
without an identifier is linked by its text like any other, and a class of only such rows
has a null name; different texts under one identifier are linked each by itself; ties do
not arise, classes being named by their least identifier; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import UPPER, WORD, settled, stored, table
from chronofold.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)
HASHES = 160
ROWS = 5
STEP = 16
TOLERANCE = 1e-5
BLOCK = 1_000
DIFFERENCES = 2_000
LEVELS = 100
BROADCAST_DOCS = 500_000
CACHED_WORDS = 300_000
SEED = np.random.default_rng(20240601)
XOR = SEED.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ODD = SEED.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
WORDS = re.compile(WORD)
LOWER = str.maketrans(UPPER, UPPER.lower())


class Shingler:
    """Distinct shingle hashes of a text, sorted."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known, words = self.known, WORDS.findall((text or "").translate(LOWER))
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(self.n, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x100000001B3) + h[i : len(h) - k + 1 + i]
            out ^= out >> np.uint64(29)
            out = out * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    for i in range(0, len(x), 16_384):
        np.minimum(low, ((x[None, i : i + 16_384] ^ XOR[:, None]) * ODD[:, None]).min(1), out=low)
    return low


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the matches that a pair needs to stay: the posterior of similarity s with a
    uniform prior is Beta(m + 1, n - m + 1), and P(s >= t) = P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


LEAST = least_matches(THRESHOLD[0] / THRESHOLD[1])


def survivors(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows of ``many`` that may still reach the threshold with ``one`` (or row by row, if it has as many)."""
    alive = np.arange(len(many))
    matches = np.zeros(len(many), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        a = one[n - STEP : n] if one.ndim == 1 else one[alive, n - STEP : n]
        matches = matches + (many[alive, n - STEP : n] == a).sum(1)
        stay = matches >= LEAST[n]
        alive, matches = alive[stay], matches[stay]
    return alive


def forest(ids: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the survivors' graph of one group."""
    left, edges = np.arange(len(ids)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = survivors(sigs[u], sigs[left])
            edges += [(ids[u], ids[v]) for v in left[hit]]
            queue += left[hit].tolist()
            left = np.delete(left, hit)
    return edges


def intersections(sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; with ``first``, of the first so many with the others."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(flat)])
    common = int((count == len(sets)).sum())
    use = (count > 1) & (count < len(sets))
    column = np.repeat(np.where(use, np.cumsum(use) - 1, -1), count)
    got = column >= 0
    column, who = column[got], who[got]
    cut = len(sets) if first is None else first
    inter = np.full((cut, len(sets) if first is None else len(sets) - cut), float(common), np.float32)
    width = 4_096
    cuts = np.searchsorted(column, np.arange(0, int(use.sum()) + width, width))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            m = np.zeros((len(sets), width), np.float32)
            m[who[a:b], column[a:b] - i * width] = 1.0
            inter += m @ m.T if first is None else m[:cut] @ m[cut:].T
    return np.rint(inter).astype(np.int64)


def square(linked: np.ndarray, first: int | None) -> np.ndarray:
    """A symmetric matrix of links, none of a text with itself; with ``first``, from the block of the cross pairs."""
    if first is not None:
        n = sum(linked.shape)
        whole = np.zeros((n, n), bool)
        whole[:first, first:] = linked
        whole[first:, :first] = linked.T
        return whole
    np.fill_diagonal(linked, False)
    return linked


def exact_links(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of pairs that reach the threshold."""
    num, den = THRESHOLD
    size = np.array([len(s) for s in sets], np.int64)
    return square(intersections(sets) * (num + den) >= num * (size[:, None] + size[None, :]), None)


def difference_links(size: np.ndarray, sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """The same from the texts' numbers of shingles and their differences from one centre: the difference of
    two texts is the difference of these."""
    num, den = THRESHOLD
    d = np.array([len(s) for s in sets], np.int64)
    a, b = (slice(None), slice(None)) if first is None else (slice(first), slice(first, None))
    both = size[a, None] + size[None, b]
    apart = d[a, None] + d[None, b] - 2 * intersections(sets, first)
    return square((both - apart) * (num + den) >= 2 * num * both, first)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if left[root]:
            left[root] = False
            queue = [root]
            while queue:
                u = queue.pop()
                new = np.flatnonzero(linked[u] & left)
                left[new] = False
                edges += [(u, int(v)) for v in new]
                queue += new.tolist()
    return edges


def grouped(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 1) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, of about ``least`` rows or more, from a stream sorted by ``keys``."""
    rest, held, rows = None, [], 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < least:
            continue
        pdf = pd.concat(([] if rest is None else [rest]) + held, ignore_index=True)
        held, rows = [], 0
        last = pdf[keys].iloc[-1]
        open_ = np.logical_and.reduce([pdf[k].to_numpy() == last[k] for k in keys])
        rest = pdf[open_]
        if not open_.all():
            yield pdf[~open_]
    if held or rest is not None:
        yield pd.concat(([] if rest is None else [rest]) + held, ignore_index=True)


def starts_of(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    change = np.zeros(len(pdf), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    change[0] = True
    return np.r_[np.flatnonzero(change), len(pdf)]


def _block(size: str, ident: str, most: int) -> tuple[Column, Column]:
    """Number of blocks of a group of so many, and the block of a row."""
    n = F.ceil(F.col(size) / most).cast("int")
    return n, F.pmod(F.xxhash64(ident), n.cast("long")).cast("int")


def signatures(docs: DataFrame) -> DataFrame:
    """Per class of equal texts: ``sha, rep`` (least identifier), ``copies, sig, bands`` (null ``sig`` without words)."""

    def sign(batches):
        shingle = Shingler()
        for pdf in batches:
            made: dict[str, tuple] = {}
            for sha, text in zip(pdf["sha"], pdf["text"]):
                if sha not in made:
                    s = shingle(text)
                    if len(s):
                        low = minhash(s)
                        bands = [xxhash.xxh3_64_intdigest(low[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, HASHES, ROWS)]
                        made[sha] = ((low >> np.uint32(16)).astype(np.uint8).tobytes(), np.array(bands, np.int64))
                    else:
                        made[sha] = (None, np.zeros(0, np.int64))
            rows = [made[s] for s in pdf["sha"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sha": pdf["sha"], "sig": [r[0] for r in rows], "bands": [r[1] for r in rows]})

    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _sha(docs).alias("sha"), docs["text"])
    signed = keyed.mapInPandas(sign, "doc_id long, sha string, sig binary, bands array<long>")
    # Equal texts have equal values, so any one's do; copies are merged before the shuffle.
    return signed.groupBy("sha").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )


def _sha(docs: DataFrame):
    return F.base64(F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)))


def candidate_edges(reps: DataFrame) -> DataFrame:
    """``a, b``: spanning edges of what the Bayesian comparison leaves of each band's group."""
    bands = reps.where(F.col("sig").isNotNull()).select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    member = bands.join(sizes, "band")
    n, own = _block("n", "node", BLOCK)
    tie = F.when(n > 1, F.col("least")).otherwise(-1)
    rows = member.select("band", own.alias("block"), tie.alias("tie"), "node").join(reps.select("node", "sig"), "node")
    keys = ["band", "block"]

    def search(batches):
        for pdf in grouped(batches, keys):
            ids = pdf["node"].to_numpy()
            tie = pdf["tie"].to_numpy()
            sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), HASHES)
            at = starts_of(pdf, keys)
            size = np.diff(at)
            two = at[:-1][size == 2]
            ok = two[survivors(sigs[two], sigs[two + 1])] if len(two) else two
            edges = list(zip(ids[ok], ids[ok + 1]))
            for s, n in zip(at[:-1][size > 2], size[size > 2]):
                edges += forest(ids[s : s + n], sigs[s : s + n])
            edges += [(ids[s], int(tie[s])) for s in at[:-1] if tie[s] >= 0]
            if edges:
                e = np.array(edges, np.int64)
                yield pd.DataFrame({"a": e.min(1), "b": e.max(1)}).drop_duplicates()

    dealt = rows.select(*keys, "tie", "node", "sig").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(search, "a long, b long")


def _forest_rows(ids: np.ndarray, linked: np.ndarray):
    """Columns ``a, b, links``: numbers of links (null ``b``), and spanning edges."""
    n = linked.sum(1)
    some = np.flatnonzero(n)
    edges = spanning(linked)
    a = ids[some].tolist() + [ids[u] for u, _ in edges]
    return a, [None] * len(some) + [ids[v] for _, v in edges], n[some].tolist() + [0] * len(edges)


LINKS = "a long, b long, links long"


def verified(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b, links``: rows with a null ``b`` have numbers of exact links of ``a``; the others are spanning
    edges. ``groups``: ``node, component``."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    n, own = _block("n", "node", BLOCK)
    # The centre, a component's least node, goes to each of its blocks.
    place = F.when((F.col("node") == F.col("component")) & (n > 1), F.sequence(F.lit(0), n - 1)).otherwise(F.array(own))
    placed = groups.join(sizes, "component").select("node", "component", n.alias("n_blocks"), own.alias("own"), F.explode(place).alias("block"))
    placed = settled(placed.join(reps.select("node", "rep", F.col("sha").alias("r_sha")), "node"))
    few = placed.count() <= BROADCAST_DOCS
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _sha(docs).alias("sha"), docs["text"])
    rows = texts.join(
        F.broadcast(placed) if few else placed,
        (F.col("sha") == F.col("r_sha")) & F.col("doc_id").eqNullSafe(F.col("rep")),
    )
    keys = ["component", "block"]

    def verify(batches):
        shingle = Shingler()
        for whole in grouped(batches, keys):
            at = starts_of(whole, keys)
            a, b, links, far = [], [], [], []
            for s, e in zip(at[:-1], at[1:]):
                pdf = whole.iloc[s:e].drop_duplicates("node")
                ids, group = pdf["node"].to_numpy(), int(pdf["component"].iloc[0])
                sets = [shingle(t) for t in pdf["text"]]
                if pdf["n_blocks"].iloc[0] == 1:
                    for column, values in zip((a, b, links), _forest_rows(ids, exact_links(sets))):
                        column += values
                    continue
                centre = sets[int(np.flatnonzero(ids == group)[0])]
                for i in np.flatnonzero(pdf["own"].to_numpy() == pdf["block"].to_numpy()):
                    d = np.setxor1d(sets[i], centre, assume_unique=True)
                    union = (len(sets[i]) + len(centre) + len(d)) // 2
                    far.append((ids[i], group, len(sets[i]), (LEVELS * len(d) + union - 1) // union, d.tobytes()))
            if a:
                yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": np.array(links, np.int64)}).assign(
                    component=pd.NA, size=pd.NA, level=pd.NA, diff=None
                )
            if far:
                out = pd.DataFrame(far, columns=["a", "component", "size", "level", "diff"])
                yield out.assign(b=pd.NA, links=0)[["a", "b", "links", "component", "size", "level", "diff"]]

    dealt = rows.select(*keys, "n_blocks", "own", "node", "text").repartition(*keys).sortWithinPartitions(*keys)
    out = stored(dealt.mapInPandas(verify, LINKS + ", component long, size long, level int, diff binary"))
    small = out.where(F.col("diff").isNull()).select("a", "b", "links")
    members = out.where(F.col("diff").isNotNull()).select("component", F.col("a").alias("node"), "size", "level", "diff")
    return small.unionByName(_large_groups(members)) if members.limit(1).count() else small


def _large_groups(members: DataFrame) -> DataFrame:
    """``a, b, links`` of groups of many blocks, from differences (``component, node, size, level, diff``)."""
    num, den = THRESHOLD
    near = LEVELS * (den - num) // den
    levels = settled(members.groupBy("component", "level").agg(F.count(F.lit(1)).alias("n")))
    other = levels.select("component", F.col("level").alias("l2"), F.col("n").alias("n2"))
    # A level is an upper bound of the distance to the centre that is less than one level too high.
    sure = F.col("level") + F.col("l2") <= near
    open_ = ~sure & (F.abs(F.col("level") - F.col("l2")) <= near)
    blocks = F.ceil(F.col("n2") / DIFFERENCES).cast("int")
    plan = levels.join(other, "component").groupBy("component", "level", "n").agg(
        F.sum(F.when(sure, F.col("n2") - (F.col("level") == F.col("l2")).cast("int")).otherwise(0)).alias("sure"),
        F.collect_list(F.when(open_, F.struct("l2", blocks.alias("blocks")))).alias("open"),
    )
    rows = members.join(plan, ["component", "level"])
    certain = rows.where("sure > 0").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.col("sure").alias("links"))
    centre = members.where((F.col("level") <= near) & (F.col("node") != F.col("component"))).select(
        F.col("node").alias("a"), F.col("component").alias("b"), F.lit(0).cast("long").alias("links")
    )
    _, own = _block("n", "node", DIFFERENCES)
    each = F.flatten(F.transform("open", lambda o: F.transform(F.sequence(F.lit(0), o["blocks"] - 1), lambda i: F.struct(o["l2"].alias("level"), i.alias("block")))))
    me = F.struct(F.col("level").alias("level"), own.alias("block"))
    pairs = rows.select("component", "node", "size", "diff", me.alias("me"), F.explode(each).alias("it"))
    pairs = pairs.select(
        "component", F.least("me", "it").alias("lo"), F.greatest("me", "it").alias("hi"), (F.col("me") > F.col("it")).alias("side"), "node", "size", "diff"
    ).select("component", F.col("lo.level").alias("la"), F.col("lo.block").alias("ba"), F.col("hi.level").alias("lb"), F.col("hi.block").alias("bb"), "side", "node", "size", "diff")
    keys = ["component", "la", "ba", "lb", "bb"]

    def compare(batches):
        for whole in grouped(batches, keys):
            at = starts_of(whole, keys)
            for s, e in zip(at[:-1], at[1:]):
                pdf = whole.iloc[s:e].sort_values("side", kind="stable")
                key = pdf[keys].iloc[0]
                own = key["la"] == key["lb"] and key["ba"] == key["bb"]
                sets = [np.frombuffer(d, np.uint64) for d in pdf["diff"]]
                first = None if own else int((~pdf["side"]).sum())
                if first in (0, len(pdf)):
                    continue
                linked = difference_links(pdf["size"].to_numpy(np.int64), sets, first)
                a, b, links = _forest_rows(pdf["node"].to_numpy(), linked)
                yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": np.array(links, np.int64)})

    dealt = pairs.repartition(*keys).sortWithinPartitions(*keys)
    return certain.unionByName(centre).unionByName(dealt.mapInPandas(compare, LINKS))


def classes_of_texts(docs: DataFrame) -> DataFrame:
    """Per different text: ``sha, rep, copies, root`` (a number of its class), ``class_id``, ``n_links`` and ``linked``."""
    reps = stored(signatures(docs).withColumn("node", F.monotonically_increasing_id()))
    checked = settled(verified(docs, reps, components(candidate_edges(reps))))
    classes = components(checked.where("b is not null").select("a", "b"))
    counts = checked.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    linked = counts.join(classes, F.col("a") == F.col("node")).select("node", "component", "links")
    linked = settled(linked.join(reps.select("node", "rep"), "node"))
    names = _small(linked.groupBy("component").agg(F.min("rep").alias("name")))
    linked = linked.join(names, "component").select("node", "component", "links", "name")
    return reps.select("sha", "rep", "copies", "node").join(linked, "node", "left").select(
        "sha", "rep", "copies", F.coalesce("component", "node").alias("root"),
        F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("name")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("component").isNotNull().alias("linked"),
    )


def _small(classes: DataFrame) -> DataFrame:
    """A row per class of links, to be broadcast if they are few, so that a large class's rows stay where they are."""
    classes = settled(classes)
    return F.broadcast(classes) if classes.count() <= BROADCAST_DOCS else classes


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, rep_id`` (least identifier of the equal texts), ``class_id`` (least
    identifier of all that links connect) and ``n_links`` (other texts at 0.8 or more)."""
    by_text = classes_of_texts(docs).select("sha", F.col("rep").alias("rep_id"), "class_id", "n_links")
    rows = docs.select(docs["doc_id"], _sha(docs).alias("sha"))
    return rows.join(by_text, "sha", "left").select("doc_id", "rep_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least identifier of every class (of several texts with it, the one with the least
    SHA-256; a null identifier comes last), with the columns it had. Rows that repeat it in identifier and
    text stay with it."""
    texts = stored(classes_of_texts(docs))
    linked = texts.where("linked")
    classes = _small(linked.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "sha")).alias("kept")))
    known = linked.join(classes, "root").select("sha", F.when(F.col("sha") == F.col("kept.sha"), F.struct("rep")).alias("keep"))
    # Texts that occur once and have no link need no decision.
    known = stored(known.unionByName(texts.where("not linked and copies > 1").select("sha", F.struct("rep").alias("keep"))))
    few = known.count() <= BROADCAST_DOCS
    rows = docs.select(_sha(docs).alias("_sha"), docs["doc_id"].cast("long").alias("_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = rows.join(F.broadcast(known) if few else known, F.col("_sha") == F.col("sha"), "left")
    stays = F.col("sha").isNull() | (F.col("keep").isNotNull() & F.col("_id").eqNullSafe(F.col("keep.rep")))
    return found.where(stays).select("row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
