"""Corrections that carry all dependents or are refused, splits that are refused, and leased jobs."""

import pytest
from pyspark.sql import functions as F

from chronofold.operators import corrections as C
from chronofold.operators import jobs as J
from chronofold.operators.view import visible

FACT = ", revealed_at int, invalid_at int, retracted_at timestamp"


def test_split_refuses_gaps(spark):
    df = spark.createDataFrame
    entities = df([("e", "E", "person", 1, None, None), ("x", "X", "person", 1, 5, None)], "entity_id string, canonical_name string, type string" + FACT)
    aliases = df([(1, "e", "a", 1, None), (2, "e", "late", 50, None)], "alias_id long, entity_id string, surface string, revealed_at int, retracted_at timestamp")
    edges = df([(7, "e", "x", 2, None, None), (8, "y", "e", 2, 4, None)], "edge_id long, src_entity string, dst_entity string" + FACT)
    people = df([(9, "e", 3)], "event_id long, entity_id string, revealed_at int")
    parts = df([("p", "P", "person"), ("q", "Q", "person")], "part_id string, canonical_name string, type string")
    give = lambda *rows: df(list(rows), "id long, part_id string")
    ok = dict(entity_id="e", at=10, parts=parts, alias_map=give((1, "p")), edge_map=give((7, "q")), event_map=give((9, "p"), (9, "q")))
    got = {(r.kind, r.id, r.owner) for r in C.split(entities, aliases, edges, people, **ok).collect()}
    assert got == {("entity", "p", "p"), ("entity", "q", "q"), ("alias", "1", "p"), ("edge", "7", "q"), ("event", "9", "p"), ("event", "9", "q")}
    loop = edges.unionByName(df([(10, "e", "e", 2, None, None)], edges.schema))
    for change, e in [
        ({"entity_id": "x"}, edges), ({"entity_id": "z"}, edges), ({"parts": parts.limit(1)}, edges), ({"parts": parts.withColumn("type", F.lit("place"))}, edges),
        ({"alias_map": give()}, edges), ({"alias_map": give((1, "p"), (2, "p"))}, edges), ({"edge_map": give((7, "r"))}, edges), ({"event_map": give()}, edges), ({}, loop),
    ]:
        with pytest.raises(ValueError):
            C.split(entities, aliases, e, people, **(ok | change))


def test_leases(spark):
    rows = [(1, "running", 7, 2, 3, False, 100), (2, "leased", 7, 2, 3, False, 0), (3, "running", 7, 3, 3, False, 100), (4, "running", 7, 2, 3, True, 100), (5, "pending", 7, 0, 3, False, None), (6, "leased", 7, 3, 3, False, 0)]
    jobs = spark.createDataFrame(rows, "job_id int, state string, token int, attempt_count int, max_attempts int, cancel_requested boolean, t int").withColumn("lease_until", F.timestamp_seconds("t"))
    claims = jobs.select("job_id", F.col("token").alias("claim_token"), F.col("attempt_count").alias("claim_attempt"), F.lit(True).alias("retryable"), F.lit(30).alias("retry_seconds"))
    now = F.timestamp_seconds(F.lit(50))
    got = {r.job_id: (r.state, r.t) for r in J.fail(claims, jobs, now).select("job_id", "state", F.unix_timestamp("run_after").alias("t")).collect()}
    assert got == {1: ("pending", 80), 2: ("lost", None), 3: ("failed", None), 4: ("cancelled", None), 5: ("lost", None), 6: ("lost", None)}
    assert {r.state for r in J.fail(claims.withColumn("claim_token", F.lit(8)), jobs, now).collect()} == {"lost"}
    assert {r.job_id: r.state for r in J.expire(jobs, now).collect()} == {2: "pending", 6: "failed"}


@pytest.fixture
def story(spark):
    df = spark.createDataFrame
    people = [(i, n, t, r, e, None) for i, n, t, r, e in [("a", "Ann", "person", 1, None), ("b", "Annie", "person", 2, None), ("c", "Carl", "person", 1, None), ("p", "Paris", "place", 1, None), ("x", "Gone", "person", 1, 3), ("l", "Late", "person", 9, None)]]
    return C.Story(
        entities=df(people, "entity_id string, canonical_name string, type string" + FACT),
        aliases=df([(1, "a", "Miss A", 1, None), (2, "b", "MISS A", 2, None), (3, "b", "Anna", 50, None), (4, "a", "Lady", 2, None)], "alias_id long, entity_id string, surface string, revealed_at int, retracted_at timestamp"),
        edges=df([(1, "a", "b", "knows", "l", 2, None, None), (2, "a", "c", "loves", "l", 3, 20, None), (3, "b", "c", "loves", "l", 4, 20, None), (4, "c", "a", "old", "l", 1, 3, None), (5, "a", "x", "was", "l", 1, None, None), (6, "c", "b", "hates", "l", 12, None, None)], "edge_id long, src_entity string, dst_entity string, rel_type string, label string" + FACT),
        events=df([(10, 1, None, None), (11, 2, None, None), (12, 2, 4, None)], "event_id long, revealed_at int, invalid_at int, retracted_at timestamp"),
        participants=df([(10, "a", "host", 1), (10, "b", "guest", 2), (11, "b", "guest", 2), (12, "a", "ghost", 2)], "event_id long, entity_id string, role string, revealed_at int"),
        states=df([(1, "a", "{\"mood\":1}", 1, 3, None), (2, "a", "{\"mood\":2}", 3, None, None), (3, "b", "{\"mood\":9}", 2, None, None)], "state_id long, entity_id string, status_json string" + FACT),
    )


def remap_of(spark, *rows):
    return spark.createDataFrame(list(rows), "old_id string, new_id string, new_name string")


def added(changes, kind, *columns):
    return sorted(tuple(r[c] for c in columns) for r in changes.where(f"op = 'add' and kind = '{kind}'").collect())


def test_replacement_carries_every_dependent(spark, story):
    log = C.correct(story, remap_of(spark, ("a", "n", " Nora ")), 5)
    assert [(r.id, r.until) for r in log.where("op = 'end'").collect()] == [("a", 5)]
    assert added(log, "entity", "entity", "text", "label") == [("n", "Nora", "person")]
    assert added(log, "alias", "text") == [("Ann",), ("Lady",), ("Miss A",)]
    assert added(log, "edge", "id", "src", "dst", "until") == [("1", "n", "b", None), ("2", "n", "c", 20)]
    assert added(log, "participant", "id", "text") == [("10", "host")]
    assert added(log, "state", "id", "text") == [("2", '{"mood":2}')]
    after = C.applied(story, log, 5)
    assert {r.entity_id for r in visible(after.entities, 4).collect()} == {"a", "b", "c", "p"}
    assert {r.entity_id for r in visible(after.entities, 5).collect()} == {"n", "b", "c", "p"}
    assert {(r.surface) for r in after.aliases.where("entity_id = 'n' and revealed_at = 5").collect()} == {"Ann", "Lady", "Miss A"}
    assert {(r.edge_id, r.src_entity) for r in visible(after.edges, 5).where("edge_id < 0").collect()} == {(-1, "n"), (-2, "n")}
    assert after.participants.where("entity_id = 'n'").count() == 1 and after.states.where("entity_id = 'n'").first().status_json == '{"mood":2}'


def test_merge_settles_roles_loops_and_repeats(spark, story):
    remap = remap_of(spark, ("a", "m", "Anna K"), ("b", "m", "Anna K"))
    with pytest.raises(ValueError, match="conflicting roles: 10"):
        C.correct(story, remap, 5)
    roles = spark.createDataFrame([("m", 10, "both")], "target string, event_id long, role string")
    states = spark.createDataFrame([("m", "{}")], "target string, status_json string")
    log = C.correct(story, remap, 5, roles=roles, states=states)
    assert added(log, "participant", "id", "text") == [("10", "both"), ("11", "guest")]
    assert added(log, "edge", "id", "src", "dst", "text") == [("2", "m", "c", "loves")]  # the loop and the repeat are gone
    assert added(log, "alias", "text") == [("Ann",), ("Annie",), ("Lady",), ("Miss A",)]
    assert added(log, "state", "text") == [("{}",)]
    after = C.applied(story, log, 5)
    assert visible(after.edges, 5).where("src_entity = 'm' or dst_entity = 'm'").count() == 1


def test_two_corrections_at_once_share_an_edge(spark, story):
    log = C.correct(story, remap_of(spark, ("a", "n", "N"), ("c", "k", "K")), 5)
    assert added(log, "edge", "id", "src", "dst") == [("1", "n", "b"), ("2", "n", "k"), ("3", "b", "k")]


@pytest.mark.parametrize("rows,roles", [
    ([("x", "n", "N")], None), ([("zz", "n", "N")], None), ([("l", "n", "N")], None), ([("a", "n", "  ")], None), ([("a", "n", "ANN")], None), ([("a", "m", "M"), ("p", "m", "M")], None),
    ([("a", "m", "M"), ("c", "m", "Q")], None), ([("a", "n", "N"), ("a", "m", "M")], None), ([("a", "n", "N")], [("n", 77, "r")]),
])
def test_refused_corrections(spark, story, rows, roles):
    roles = roles and spark.createDataFrame(roles, "target string, event_id long, role string")
    with pytest.raises(ValueError):
        C.correct(story, remap_of(spark, *rows), 5, roles=roles)


def test_an_edge_between_two_sources_is_one_row(spark):
    df = spark.createDataFrame
    times = "revealed_at int, invalid_at int, retracted_at timestamp"
    entities = df([(c, 1, None, None) for c in "abc"], "entity_id string, " + times)
    edges = df([(1, "a", "b", "r", "l", 1, None, None), (2, "a", "c", "r", "l", 1, None, None), (3, "c", "c", "r", "l", 1, None, None)], "edge_id long, src_entity string, dst_entity string, rel_type string, label string, " + times)
    story = C.Story(entities, None, edges, None, None, None)
    to = df([("a", "n"), ("b", "m")], "source string, target string")
    assert sorted((r.edge_id, r.s, r.d) for r in C._edges(story, to, 9).select("edge_id", C._moved("src").alias("s"), C._moved("dst").alias("d")).collect()) == [(1, "n", "m"), (2, "n", "c")]
