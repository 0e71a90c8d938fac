"""Exact vector search that filters before it ranks.

Similarities are JVM-side expressions in double precision; a top-k is a total order and
a limit, which Spark plans as per-task heaps and one merge. Many queries at once are compared in
blocks by numpy, with the same scores. No index, no approximation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or a value is not finite: such rows are no candidates."""
    n = norm(a) * norm(b)
    c = F.try_divide(dot(a, b), n)
    return F.when((n > 0) & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    if metric == "inner_product":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def search(chunks: DataFrame, query: list[float], k: int, *, dimension: int | None = None) -> DataFrame:
    """The k most similar rows of ``chunks``, which the caller has filtered; ties go to the greater key."""
    if type(k) is not int or k < 0:
        raise ValueError("k is an int of 0 or more")
    q = F.array(*[F.lit(float(x)) for x in query])
    if not query:
        return chunks.limit(0).withColumn("score", F.lit(None).cast("double"))
    rows = chunks.where(F.size("vec") == (dimension or len(query)))
    return rows.withColumn("score", cosine(F.col("vec"), q)).where("score is not null").orderBy(F.desc("score"), F.desc("chapter_key")).limit(k)


class StaleIndex(RuntimeError):
    """An index that is not what would be derived from its rows now."""


def derived(rows: DataFrame) -> DataFrame:
    """The candidate index of ``rows``: unit vectors in single precision, ``chunk_id, unit, model``. Rows without a direction have none."""
    n = norm(F.col("vec"))
    unit = F.transform("vec", lambda x: (x.cast("double") / n).cast("float"))
    return rows.where((n > 0) & ~F.isnan(n) & (n < float("inf"))).select("chunk_id", unit.alias("unit"), "model")


def checked(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``index`` if it holds exactly what ``rows`` derive; raises ``StaleIndex`` where a row is missing, left over or another one."""
    stored = index.select(F.col("chunk_id").alias("i_id"), F.col("unit").alias("i_unit"), F.col("model").alias("i_model"))
    both = derived(rows).join(stored, F.col("chunk_id") == F.col("i_id"), "full")
    same = F.col("chunk_id").isNotNull() & F.col("i_id").isNotNull() & F.col("unit").eqNullSafe(F.col("i_unit")) & F.col("model").eqNullSafe(F.col("i_model"))
    if both.where(~same).limit(1).count():
        raise StaleIndex("the index differs from its rows")
    return index


SINGLE = 1e-5  # more than what a unit vector's product loses in single precision


def search_index(rows: DataFrame, index: DataFrame, query: list[float], k: int) -> DataFrame:
    """The result of ``search``, by candidates of a single-precision index: of the visible rows' index entries
    those within ``SINGLE`` of the k-th best stay, and are scored again exactly. ``rows`` are filtered before they are ranked, and
    the index may hold more."""
    if type(k) is not int or k < 0:
        raise ValueError("k is an int of 0 or more")
    length = sum(float(x) ** 2 for x in query) ** 0.5
    if not query or not 0 < length < float("inf"):
        return search(rows, query, 0)
    q = F.array(*[F.lit(float(x) / length).cast("float") for x in query])
    near = F.aggregate(F.zip_with("unit", q, lambda x, y: x * y), F.lit(0.0).cast("float"), lambda s, x: s + x)
    found = index.join(rows.where(F.size("vec") == len(query)).select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", near.alias("near"))
    last = found.orderBy(F.desc("near")).limit(k).agg(F.min("near").alias("least"))  # one row
    candidates = found.join(F.broadcast(last), F.col("near") >= F.col("least") - SINGLE).select("chunk_id")
    return search(rows.join(candidates, "chunk_id", "left_semi"), query, k)


def search_view(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """A reader's search: 1 to 50 results."""
    if type(k) is not int or not 1 <= k <= 50:
        raise ValueError("k is an int from 1 to 50")
    return search(rows, query, k)


def sure(score: Column, second: Column, threshold: float = 0.82, margin: float = 0.05) -> Column:
    """Whether a match is good enough and clear of the second best."""
    return (score >= threshold) & (score - F.coalesce(second, F.lit(0.0)) >= margin)


def nearest_of_blocks(rows: DataFrame, asked: DataFrame, part: int = 8_192, block: int = 8_192) -> DataFrame:
    """Per query of ``asked`` (``mention, qv``) its nearest row (``candidate, embedding``), ``score`` and
    ``second``, the next best score; a row is no candidate of itself, ties go to the least candidate.

    Rows are dealt by hash into parts of about ``part`` and queries into blocks of about ``block``; each part meets each block
    in a task of bounded size, which gives on the two best of each query only. Every row is compared with every query, so the work is the product
    of their numbers."""
    spark = rows.sparkSession
    rows, asked = rows.where("candidate is not null and embedding is not null"), asked.where("mention is not null and qv is not null")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part))
    blocks = max(1, -(-asked.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = rows.select("candidate", "embedding", dealt("candidate", parts).alias("p"), every(blocks).alias("b")).repartition(parts, "p", "b")
    right = asked.select("mention", "qv", dealt("mention", blocks).alias("b"), every(parts).alias("p")).repartition(parts, "p", "b")
    kinds = ", ".join(f"{c} {t}" for c, t in [*asked.select("mention").dtypes, *rows.select("candidate").dtypes])
    each = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInPandas(lambda r, q: _two_best(r, q), f"{kinds}, score double")
    n = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "candidate"))
    best = each.withColumn("n", n).where("n <= 2")
    return best.groupBy("mention").agg(
        F.max(F.when(F.col("n") == 1, F.col("candidate"))).alias("candidate"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second")
    )


def _two_best(rows: pd.DataFrame, asked: pd.DataFrame, lanes: int = 512) -> pd.DataFrame:
    """``mention, candidate, score`` of each query's two best rows. Products in single precision say which rows may be
    among them; these are scored as ``cosine`` does, value by value in double precision."""
    found = [pd.DataFrame({"mention": asked["mention"][:0], "candidate": rows["candidate"][:0], "score": np.zeros(0)})]
    for width in set(rows["embedding"].map(len)) & set(asked["qv"].map(len)) - {0}:
        ids, vec, size = _vectors(rows["candidate"], rows["embedding"], width)
        mentions, qv, q_size = _vectors(asked["mention"], asked["qv"], width)
        if not len(ids) or not len(mentions):
            continue
        some = _told_apart(ids, vec)
        ids, vec, size = ids[some], vec[some], size[some]
        unit, q_unit = ((x / n[:, None]).astype(np.float32) for x, n in ((vec, size), (qv, q_size)))
        margin = (width + 4) * 2.0**-22  # twice what two products of unit vectors can lose
        first, last = np.searchsorted(ids, mentions), np.searchsorted(ids, mentions, "right")
        for i in range(0, len(mentions), lanes):
            near = q_unit[i : i + lanes] @ unit.T
            for k in np.flatnonzero(first[i : i + lanes] < last[i : i + lanes]).tolist():
                near[k, first[i + k] : last[i + k]] = -np.inf  # itself
            lane = np.arange(len(near))
            best = near.argmax(1)
            top = near[lane, best]
            near[lane, best] = -np.inf
            least = np.maximum(near.max(1) - margin, -2)  # a cosine is never as small
            near[lane, best] = top
            q, r = np.nonzero(near >= least[:, None])
            q += i
            score = np.zeros(len(q))
            for j in range(width):
                score += vec[r, j] * qv[q, j]
            score /= size[r] * q_size[q]
            order = np.lexsort((r, -score, q))  # rows are sorted by candidate
            q, r, score = q[order], r[order], score[order]
            two = np.ones(len(q), bool)
            two[2:] = q[2:] != q[:-2]
            found.append(pd.DataFrame({"mention": mentions[q[two]], "candidate": ids[r[two]], "score": score[two]}))
    return pd.concat(found, ignore_index=True)


def _vectors(ids: pd.Series, vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers in order, vectors of so many values, and their lengths; only those that have a direction."""
    some = (vectors.map(len) == width).to_numpy()
    ids, vec = ids[some].to_numpy(), np.stack(vectors[some].to_list()).astype(np.float64)
    size = np.zeros(len(vec))
    with np.errstate(all="ignore"):
        for j in range(width):
            size += vec[:, j] * vec[:, j]
        size = np.sqrt(size)
        ok = np.flatnonzero((size > 0) & (size < np.inf))
    ok = ok[np.argsort(ids[ok], kind="stable")]
    return ids[ok], vec[ok], size[ok]


def _told_apart(ids: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Of rows that are sorted by identifier, without those that are among no query's two best: of equal vectors two rows each of the
    least three identifiers stay, as a query may leave out one."""
    same = np.unique(vec.view(f"V{vec.shape[1] * 8}").ravel(), return_inverse=True)[1]
    t = pd.DataFrame({"same": same, "id": ids})
    nth = (~t.duplicated()).groupby(t["same"]).cumsum()
    return np.flatnonzero((nth <= 3) & (t.groupby(["same", "id"]).cumcount() < 2))


def lexical(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, bucket, weight``: words and character trigrams by their MD5's low byte, scaled to unit length. A text without
    either has no row; one of two characters has no trigram."""
    t = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]", " ")
    rows = texts.select(key, t.alias("t"))
    tokens = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    starts = F.when(F.length("t") >= 3, F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.substring("t", i, F.lit(3)))
    each = rows.select(key, F.explode(F.concat(tokens, grams)).alias("g"))
    counts = each.groupBy(key, F.conv(F.right(F.md5("g"), F.lit(2)), 16, 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / size).alias("weight"))


def index_changes(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``chunk_id, change``: what makes a derived index (``chunk_id, vec, model``) equal to ``rows`` again: ``add``,
    ``remove`` or ``replace`` (another vector or space). An index without changes may be opened."""
    b = index.select(F.col("chunk_id").alias("i_id"), F.col("vec").alias("i_vec"), F.col("model").alias("i_model"))
    both = rows.join(b, F.col("chunk_id") == F.col("i_id"), "full")
    same = F.col("vec").eqNullSafe(F.col("i_vec")) & F.col("model").eqNullSafe(F.col("i_model"))
    change = F.when(F.col("i_id").isNull(), "add").when(F.col("chunk_id").isNull(), "remove").when(~same, "replace")
    return both.select(F.coalesce("chunk_id", "i_id").alias("chunk_id"), change.alias("change")).where("change is not null")
