"""Vector search, full-text search and the lexical embedding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import fulltext as T
from chronofold.operators import vectors as V
from chronofold.operators.view import visible
from chronofold.plans.queries_views import book
from chronofold.plans.registry import query
from chronofold.plans.standins import bind
from chronofold.sources.shared import fresh_path

BM = 5
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
COS = ", q AS (SELECT vec AS qv FROM chunks WHERE chunk_id = 7), e AS (SELECT * FROM chunks WHERE revealed_at <= 5 AND retracted_at IS NULL), s AS (SELECT e.*, " + DOT.format("vec", "qv") + " / (sqrt(" + DOT.format("vec", "vec") + ") * sqrt(" + DOT.format("qv", "qv") + ")) AS score FROM e, q) "


def wanted(spark, sf) -> list[float]:
    """The vector that is asked for; empty, so that nothing is near, where its row is missing."""
    found = bind(spark, sf, "chunks").where("chunk_id = 7").select("vec").first()
    return [float(x) for x in found["vec"] or ()] if found else []


def live(spark, sf):
    return visible(bind(spark, sf, "chunks"), BM)


TOP = "SELECT chunk_id, CAST(round(score * 1000000) AS BIGINT) AS micro FROM s ORDER BY score DESC, chapter_key DESC LIMIT {0}"


def _micro(rows):
    return rows.select("chunk_id", F.round(F.col("score") * 1_000_000).cast("long").alias("micro"))


@query("topk_cosine", COS + TOP.format(10))
def topk_cosine(spark, sf):
    return _micro(V.search(live(spark, sf), wanted(spark, sf), 10))


@query("topk_vec0", COS + TOP.format(12))
def topk_vec0(spark, sf):
    """By a derived index in single precision, which is written, checked against its rows and rechecked exactly."""
    rows, path = bind(spark, sf, "chunks"), fresh_path(spark, "vectors")
    V.derived(rows).write.parquet(path)
    index = V.checked(rows, spark.read.parquet(path))
    return _micro(V.search_index(live(spark, sf), index, wanted(spark, sf), 12))


@query("topk_search_view", COS + TOP.format(50))
def topk_search_view(spark, sf):
    """A reader's search, with the most results it may ask for."""
    return _micro(V.search_view(live(spark, sf), wanted(spark, sf), 50))


@query("topk_canary", COS + TOP.format(1))
def topk_canary(spark, sf):
    """The nearest rows of all are not revealed yet; the answer must be the nearest visible one."""
    return _micro(V.search(live(spark, sf), wanted(spark, sf), 1))


@query("topk_funnel", COS + "SELECT chunk_id, CAST(round(score * 1000000) AS BIGINT) AS micro FROM s WHERE model = 'model-1' AND dimension = 64 AND revealed_at IN (SELECT revealed_at FROM chapters WHERE book_id = 'src0' AND retracted_at IS NULL AND revealed_at <= 5) ORDER BY score DESC, chapter_key DESC LIMIT 8")
def topk_funnel(spark, sf):
    chapters = book(spark, sf, BM).chapters().select("revealed_at")
    rows = live(spark, sf).where("model = 'model-1' and dimension = 64").join(chapters, "revealed_at", "left_semi")
    return _micro(V.search(rows, wanted(spark, sf), 8))


@query("topk_pgvector", ", q AS (SELECT vec AS qv FROM chunks WHERE chunk_id = 7), e AS (SELECT * FROM chunks WHERE revealed_at <= 5 AND retracted_at IS NULL), s AS (SELECT chunk_id, 1 - " + DOT.format("vec", "qv") + " / (sqrt(" + DOT.format("vec", "vec") + ") * sqrt(" + DOT.format("qv", "qv") + ")) AS c, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(vec[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE), 2)))) AS l, -" + DOT.format("vec", "qv") + " AS p FROM e, q) SELECT 'cosine' AS metric, * FROM (SELECT chunk_id FROM s ORDER BY c, chunk_id LIMIT 5) UNION ALL SELECT 'l2', * FROM (SELECT chunk_id FROM s ORDER BY l, chunk_id LIMIT 5) UNION ALL SELECT 'inner_product', * FROM (SELECT chunk_id FROM s ORDER BY p, chunk_id LIMIT 5)")
def topk_pgvector(spark, sf):
    q = F.array(*[F.lit(x) for x in wanted(spark, sf)])
    out = None
    for metric in ("cosine", "l2", "inner_product"):
        rows = live(spark, sf).withColumn("d", V.distance(metric, F.col("vec"), q)).orderBy("d", "chunk_id").limit(max(0, min(5, 100)))
        rows = rows.select(F.lit(metric).alias("metric"), "chunk_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def fts_sql(where: str, terms: tuple[str, str]) -> str:
    """SQL of a search for two words: covers end at hits at which the older of the two last places moves on."""
    x, y = terms
    return rf""", w AS (SELECT {where}), h AS (SELECT id, i, w[i] AS x, w FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w) z WHERE w[i] IN ('{x}', '{y}')),
l AS (SELECT id, i, row_number() OVER o AS k, max(i) FILTER (WHERE x = '{x}') OVER o AS a, max(i) FILTER (WHERE x = '{y}') OVER o AS b FROM h WINDOW o AS (PARTITION BY id ORDER BY i)),
s AS (SELECT l.*, least(l.a, l.b) AS st FROM l WHERE l.a IS NOT NULL AND l.b IS NOT NULL), c AS (SELECT *, lag(st) OVER (PARTITION BY id ORDER BY i) AS prev FROM s),
f AS (SELECT c.id, sum(0.1 / (1 + (c.i - c.st) - (c.k - l.k))) AS score FROM c JOIN l ON l.id = c.id AND l.i = c.st WHERE c.prev IS NULL OR c.st > c.prev GROUP BY 1) """


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w"
DOCS = fts_sql("doc_id AS id, " + TOKENS.format("text") + " FROM documents", ("the", "tion"))
MICRO = "CAST(round(score * 1000000) AS BIGINT) AS micro"


@query("str_rank_cd", DOCS + "SELECT id AS doc_id, " + MICRO + " FROM f")
def str_rank_cd(spark, sf):
    """Cover density of two wanted words, of every document that has both."""
    groups = T.parse_web("the tion")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.text_words(F.col("text")).alias("w")).where(T.matches(F.col("w"), groups))
    return rows.select("doc_id", F.round(T.rank_cover_density(F.col("w"), groups) * 1_000_000).cast("long").alias("micro"))


WEB = '"of the" or die -edly'


@query("str_websearch", r", w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents) SELECT doc_id FROM w WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') OR (list_contains(w, 'die') AND NOT list_contains(w, 'edly'))")
def str_websearch(spark, sf):
    """A phrase, or a word without another one."""
    return spark.read.parquet(f"{sf}/documents.parquet").where(T.text_matches(F.col("text"), T.parse_web(WEB))).select("doc_id")


CHAPTERS = fts_sql("doc_id AS id, " + TOKENS.format("text") + " FROM chapters WHERE book_id = 'src0' AND revealed_at <= 5 AND retracted_at IS NULL", ("the", "tion"))


@query("topk_fts", CHAPTERS + "SELECT id AS doc_id, " + MICRO + " FROM f ORDER BY score DESC, id LIMIT 8")
def topk_fts(spark, sf):
    """Search of one book's completed chapters, up to the bookmark."""
    found = T.search(book(spark, sf, BM).chapters(), "the tion", key="doc_id", limit=8)
    return found.select("doc_id", F.round(F.col("score") * 1_000_000).cast("long").alias("micro"))


def head_sql(limit: int, count: int, least: int, most: int, left: str, right: str) -> str:
    """SQL of the headlines of the best ``limit``: the best cover, grown evenly, and for ``count`` 2 the best of the rest beside it."""
    inside = "len(list_filter(h, lambda p: p >= {0} AND p <= {1}))".format("s0", "e0")
    grown = "greatest({lo}, s0 - (%d - (e0 - s0 + 1)) // 2)" % most
    return f""", tp AS (SELECT f.id, score, w.w, list_filter(range(1, len(w.w) + 1), lambda i: w.w[i] IN ('the', 'tion')) AS h FROM f JOIN w USING (id) ORDER BY score DESC, f.id LIMIT {limit}),
cv AS (SELECT DISTINCT tp.id, tp.w, tp.h, c.st AS s0, least(c.i, c.st + {most} - 1) AS e0 FROM tp JOIN c USING (id) WHERE c.prev IS NULL OR c.st > c.prev),
a0 AS (SELECT *, {grown.format(lo=1)} AS a FROM cv QUALIFY row_number() OVER (PARTITION BY id ORDER BY {inside} DESC, e0 - s0, s0) = 1),
a1 AS (SELECT id, w, greatest(1, least(len(w), a + {most} - 1) - {most} + 1) AS a, least(len(w), a + {most} - 1) AS b FROM a0),
b0 AS (SELECT cv.*, CASE WHEN s0 > a1.b THEN a1.b + 1 ELSE 1 END AS lo, CASE WHEN s0 > a1.b THEN len(cv.w) ELSE a1.a - 1 END AS hi FROM cv JOIN a1 USING (id) WHERE {count} > 1 AND (s0 > a1.b OR e0 < a1.a)),
b1 AS (SELECT *, {grown.format(lo="lo")} AS x FROM b0), b2 AS (SELECT *, least(hi, x + {most} - 1) AS b FROM b1), b3 AS (SELECT *, greatest(lo, b - {most} + 1) AS a FROM b2),
b4 AS (SELECT * FROM b3 WHERE b - a + 1 >= {least} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {inside} DESC, e0 - s0, s0) = 1),
fr AS (SELECT id, w, a, b FROM a1 UNION ALL SELECT id, w, a, b FROM b4)
SELECT id AS doc_id, string_agg(array_to_string(list_transform(w[a : b], lambda x: CASE WHEN x IN ('the', 'tion') THEN '{left}' || x || '{right}' ELSE x END), ' '), ' ... ' ORDER BY a) AS headline FROM fr GROUP BY 1"""


@query("str_headline", DOCS + head_sql(20, 1, 12, 36, "[", "]"))
def str_headline(spark, sf):
    """One fragment of 12 to 36 words around the best cover."""
    return T.search(spark.read.parquet(f"{sf}/documents.parquet"), "the tion", key="doc_id", limit=20).select("doc_id", "headline")


@query("topk_fts_ask", CHAPTERS + head_sql(6, 2, 16, 70, "", ""))
def topk_fts_ask(spark, sf):
    """The passages an answer may cite: the best six of the completed chapters, in two fragments of 16 to 70 words."""
    found = T.search(book(spark, sf, BM).chapters(), "the tion", key="doc_id", limit=6, count=2, least=16, most=70, marks=("", ""))
    return found.select("doc_id", "headline")


@query("topk_ask_sources", DOCS + r""", m AS (SELECT d.doc_id, score, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM f JOIN documents d ON d.doc_id = f.id), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, doc_id) AS d FROM m WHERE t <> '')
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS n, doc_id, left(t, 2000) AS passage FROM o WHERE d = 1 ORDER BY score DESC, doc_id LIMIT 6""")
def topk_ask_sources(spark, sf):
    """The six best different passages for a question, numbered to be cited."""
    groups = T.parse_web("the tion")
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("w", T.text_words(F.col("text"))).where(T.matches(F.col("w"), groups))
    ranked = rows.select("doc_id", "text", T.rank_cover_density(F.col("w"), groups).alias("score"))
    return T.sources(ranked, key="doc_id").select("n", "doc_id", "passage")


EMBED = ", m AS (SELECT vec_id AS mention, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT mention, vec_id, " + DOT.format("embedding", "qv") + " / (sqrt(" + DOT.format("embedding", "embedding") + ") * sqrt(" + DOT.format("qv", "qv") + ")) AS score FROM m JOIN embeddings e ON vec_id <> mention), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, vec_id) AS n, lead(score) OVER (PARTITION BY mention ORDER BY score DESC, vec_id) AS second FROM p WHERE isfinite(score)) "


@query("topk_embed_match", EMBED + "SELECT mention, vec_id AS candidate, score >= 0.82 AND score - coalesce(second, 0) >= 0.05 AS sure FROM r WHERE n = 1")
def topk_embed_match(spark, sf):
    """A stated set of queries against all vectors: the nearest, and whether it is near enough (0.82) and clear
    of the second (0.05)."""
    c = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = c.where("vec_id % 100 = 0").select(F.col("vec_id").alias("mention"), F.col("embedding").alias("qv"))
    return V.nearest_of_blocks(c.select(F.col("vec_id").alias("candidate"), "embedding"), asked).select("mention", "candidate", V.sure(F.col("score"), F.col("second")).alias("sure"))


@query("math_cosine", ", a AS (SELECT chunk_id, vec FROM chunks), p AS (SELECT x.chunk_id, x.vec AS v, y.vec AS w FROM a x JOIN a y ON y.chunk_id = x.chunk_id + 1) SELECT chunk_id, CAST(round(1000000 * " + DOT.format("v", "w") + " / (sqrt(" + DOT.format("v", "v") + ") * sqrt(" + DOT.format("w", "w") + "))) AS BIGINT) AS micro FROM p")
def math_cosine(spark, sf):
    a = bind(spark, sf, "chunks").select("chunk_id", "vec")
    b = a.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vec").alias("w"))
    return a.join(b, "chunk_id").select("chunk_id", F.round(V.cosine(F.col("vec"), F.col("w")) * 1_000_000).cast("long").alias("micro"))


@query("math_canary", ", a AS (SELECT chunk_id, vec FROM chunks), p AS (SELECT x.chunk_id, x.vec AS v, y.vec AS w FROM a x LEFT JOIN a y ON y.chunk_id = x.chunk_id - x.chunk_id % 2) SELECT chunk_id, CASE WHEN " + DOT.format("v", "w") + " / (sqrt(" + DOT.format("v", "v") + ") * sqrt(" + DOT.format("w", "w") + ")) >= 0.999 THEN 'same' ELSE 're-embed' END AS space FROM p")
def math_canary(spark, sf):
    """The embedding space is unchanged only while a canary's cosine stays at 0.999 or more."""
    a = bind(spark, sf, "chunks").select("chunk_id", "vec", (F.col("chunk_id") - F.col("chunk_id") % 2).alias("canary"))
    b = a.select(F.col("chunk_id").alias("canary"), F.col("vec").alias("w"))
    same = V.cosine(F.col("vec"), F.col("w")) >= 0.999
    return a.join(b, "canary", "left").select("chunk_id", F.when(same, "same").otherwise("re-embed").alias("space"))


LEX = r", c AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g') AS t FROM benchmark), g AS (SELECT item_id, unnest(list_concat(list_filter(string_split_regex(t, '\s+'), lambda w: w <> ''), [substring(t, CAST(i AS INT), 3) FOR i IN range(1, length(t) - 1)])) AS g FROM c), h AS (SELECT item_id, CAST(('0x' || right(md5(g), 2)) AS INT) AS bucket, count(*) AS n FROM g GROUP BY 1, 2) "


@query("src_lexical_embed", LEX + "SELECT item_id, bucket, CAST(round(1000000 * n / sqrt(sum(n * n) OVER (PARTITION BY item_id))) AS BIGINT) AS micro FROM h")
def src_lexical_embed(spark, sf):
    """A 256-bucket embedding of every passage."""
    rows = V.lexical(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")
    return rows.select("item_id", "bucket", F.round(1_000_000 * F.col("weight")).cast("long").alias("micro"))


EVAL = COS.replace("revealed_at <= 5 AND ", "")


@query("eval_rag", EVAL + ", b AS (SELECT unnest(range(0, 11)) AS bm), r AS (SELECT bm, chunk_id, revealed_at, row_number() OVER (PARTITION BY bm ORDER BY score DESC, chapter_key DESC) AS n FROM b JOIN s ON s.revealed_at <= bm) SELECT bm, count(*) AS hits, count(*) FILTER (WHERE revealed_at > bm) AS leaks FROM r WHERE n <= 6 GROUP BY 1")
def eval_rag(spark, sf):
    """Every bookmark at once: the six best visible chunks, and how many of them leak (none)."""
    q = F.array(*[F.lit(x) for x in wanted(spark, sf)])
    s = visible(bind(spark, sf, "chunks"), F.lit(10)).withColumn("score", V.cosine(F.col("vec"), q))
    at = s.withColumn("bm", F.explode(F.sequence(F.col("revealed_at"), F.lit(10)))).where("revealed_at <= bm")
    n = F.row_number().over(Window.partitionBy("bm").orderBy(F.desc("score"), F.desc("chapter_key")))
    top = at.withColumn("n", n).where("n <= 6")
    return top.groupBy(F.col("bm").cast("long").alias("bm")).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("revealed_at") > F.col("bm")).alias("leaks"))
