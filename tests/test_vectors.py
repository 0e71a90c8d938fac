"""The derived index: equal to exact search, refused when stale; short texts; a reader's limits."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import vectors as V

SHAPE = "chunk_id long, chapter_key string, vec array<float>, model string"


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(6)
    rows = [(i, f"k{i:03}", [r.choice([-1.0, 0.0, 1.0, 2.0]) + r.random() * 1e-6 for _ in range(8)], "m") for i in range(300)]
    rows += [(i, f"k{i}", rows[i % 7][2], "m") for i in range(300, 340)] + [(400, "z", [0.0] * 8, "m"), (401, "y", [1.0] * 4, "m")]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.mark.parametrize("k", [0, 1, 7, 60, 1000])
def test_candidates_and_recheck_equal_exact_search(spark, chunks, k):
    query = [r["vec"] for r in chunks.where("chunk_id = 3").collect()][0]
    seen = chunks.where("chunk_id % 3 <> 1")
    got = V.search_index(seen, V.checked(chunks, V.derived(chunks)), query, k).select("chunk_id", "score").collect()
    assert got == V.search(seen, query, k).select("chunk_id", "score").collect()


def test_a_stale_index_is_refused(spark, chunks):
    index = V.derived(chunks)
    other = F.when(F.col("chunk_id") == 5, F.transform("unit", lambda x: -x)).otherwise(F.col("unit"))
    for stale in (index.withColumn("unit", other), index.where("chunk_id <> 5"), index.unionByName(index.limit(1).withColumn("chunk_id", F.lit(999).cast("long"))), index.withColumn("model", F.lit("n"))):
        with pytest.raises(V.StaleIndex):
            V.checked(chunks, stale)
    assert V.checked(chunks, index) is index


def test_what_cannot_be_asked(spark, chunks):
    for k in (0, 51, 2.0, True):
        with pytest.raises(ValueError):
            V.search_view(chunks, [1.0] * 8, k)
    assert V.search(chunks, [], 5).count() == 0 and V.search_index(chunks, V.derived(chunks), [0.0] * 8, 5).count() == 0


def test_short_texts_have_no_grams_of_their_own(spark):
    texts = spark.createDataFrame([(1, ""), (2, "a!"), (3, None), (4, "ab"), (5, "abc"), (6, "abcd")], "id int, text string")
    got = {}
    for r in V.lexical(texts, "id").collect():
        got.setdefault(r.id, []).append(r.bucket)
    import hashlib

    bucket = lambda g: hashlib.md5(g.encode()).digest()[-1]
    want = {2: {"a"}, 4: {"ab"}, 5: {"abc"}, 6: {"abcd", "abc", "bcd"}}
    assert {i: sorted(b) for i, b in got.items()} == {i: sorted({bucket(g) for g in gs}) for i, gs in want.items()}


def test_nearest_of_blocks_equals_every_pair(spark):
    r = random.Random(9)
    nan, inf = float("nan"), float("inf")
    made = lambda w: [r.choice([-1.0, 0.0, 0.5, 1.0]) + r.choice([0.0, r.random()]) for _ in range(w)]
    rows = [(i, made(8)) for i in range(400)] + [(i, made(3)) for i in range(400, 430)]
    rows += [(i, rows[0][1]) for i in range(430, 600)] + [(i, [2 * x for x in rows[5][1]]) for i in range(600, 640)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (700, [0.0] * 8), (701, [nan] * 8), (702, [inf] + [1.0] * 7), (703, None), (704, []), (705, [1.0] * 5), (None, rows[1][1]), (706, [1.0, None] * 4), (707, [1e-40, 3e38] * 4)]
    c = spark.createDataFrame(rows, "candidate long, embedding array<float>").repartition(3)
    asked = c.where("candidate % 5 = 0 or candidate > 690").select(F.col("candidate").alias("mention"), F.col("embedding").alias("qv"))
    near = V.nearest_of_blocks(c, asked, 64, 50)
    each = asked.join(c, F.col("candidate") != F.col("mention")).select("mention", "candidate", V.cosine(F.col("embedding"), F.col("qv")).alias("score")).where("score is not null")
    want = {}
    for m, x, s in sorted(map(tuple, each.collect()), key=lambda t: (t[0], -t[2], t[1])):
        want.setdefault(m, []).append((x, s))
    want = {m: (*t[0], t[1][1] if len(t) > 1 else None) for m, t in want.items()}
    assert {x.mention: (x.candidate, x.score, x.second) for x in near.collect()} == want and len(want) > 100
    assert V.nearest_of_blocks(c.limit(0), asked).count() == 0 == V.nearest_of_blocks(c, asked.limit(0)).count()
    # No row a pair: rows and queries meet in tasks.
    assert "FlatMapCoGroupsInPandas" in near._jdf.queryExecution().toString()
