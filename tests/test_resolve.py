"""Identity resolution: every layer, and mentions in order against a plain loop."""

from pyspark.sql import functions as F

from chronofold.operators import resolve as R

ROSTER = "entity_id string, type string, name string, aliases array<string>"
MENTION = "mention_id int, type string, name string, aliases array<string>, linked boolean"
PEOPLE = [
    ("e1", "character", "Zossima", ["the elder"]), ("e2", "character", "Fyodor Pavlovich Karamazov", []), ("e3", "character", "Ivan Karamazov", ["Vanya"]),
    ("e4", "place", "Ivan Karamazov", []), ("e5", "character", "Mitya", ["Dmitri"]), ("e6", "character", "Grigory", []), ("e7", "character", "Grigory", []),
    ("e8", "character", "Father Paissy", []),
]


def test_layers(spark):
    rows = [
        (1, "character", "Father Zossima", [], False), (2, "character", "zossima\u2019s", [], False), (3, "character", "IVAN karamazov", [], True),
        (4, "character", "Fyodor Karamazov", [], True), (5, "character", "Fyodor Karamazov", [], False), (6, "character", "Vanya's", [], False),
        (7, "character", "the elder", [], False), (8, "character", "Grigory", [], False), (9, "character", "Father Karamazov", [], False),
        (10, "character", "Nobody", ["Dmitri"], False), (11, "character", "Nobody Known", [], True), (12, "place", "Ivan Karamazov", [], False),
        (13, "character", "Paissy", None, False), (14, "character", None, None, False), (15, "character", "Mutter", [], False),
    ]
    got = {r.mention_id: (r.entity_id, r.method, r.warn) for r in R.resolve(spark.createDataFrame(rows, MENTION), spark.createDataFrame(PEOPLE, ROSTER)).collect()}
    assert got == {
        1: ("e1", "honorific", False), 2: ("e1", "alias", False), 3: ("e3", "roster-link", False), 4: ("e2", "roster-fuzzy", False), 5: (None, "new", False),
        6: ("e3", "alias", False), 7: (None, "new", False), 8: (None, "new", True), 9: (None, "new", False), 10: ("e5", "alias", False),
        11: (None, "new", True), 12: ("e4", "exact", False), 13: ("e8", "honorific", False), 14: (None, "new", False), 15: (None, "new", False),
    }


def test_embedding_needs_a_margin(spark):
    roster = spark.createDataFrame([(*p, v) for p, v in zip(PEOPLE[:3], ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.98, 0.2]))], ROSTER + ", vec array<double>")
    rows = [(1, "character", "A", [], False, [0.9, 0.1, 0.0]), (2, "character", "B", [], False, [0.0, 1.0, 0.1]), (3, "character", "C", [], False, [0.5, 0.5, 0.7]), (4, "character", "D", [], False, None)]
    got = {r.mention_id: (r.entity_id, r.method) for r in R.resolve(spark.createDataFrame(rows, MENTION + ", vec array<double>"), roster).collect()}
    assert got == {1: ("e1", "embedding"), 2: (None, "new"), 3: (None, "new"), 4: (None, "new")}


def test_in_order_with_a_growing_roster(spark):
    names = {
        1: [("Alyosha", False), ("Father Alyosha", False), ("Lise Hohlakov", False), ("Lise", True), ("Hohlakov Lise", True), ("alyosha's", False)],
        2: [("Lise", False), ("the elder", False), ("the elder", False), ("LISE", False)],
        3: [("Zossima", False)],
    }
    rows = [(b, i, "character", n, [], k, i) for b, x in names.items() for i, (n, k) in enumerate(x, 1)]
    mentions = spark.createDataFrame(rows, "book int, " + MENTION + ", step int")
    roster = spark.createDataFrame([(3, *PEOPLE[0])], "book int, " + ROSTER)
    got = {(r.book, r.mention_id): (r.entity_id, r.method) for r in R.resolve_in_order(mentions, roster, book="book", order="step").collect()}
    assert got == {
        (1, 1): ("new:1", "new"), (1, 2): ("new:1", "honorific"), (1, 3): ("new:3", "new"), (1, 4): ("new:4", "new"), (1, 5): ("new:3", "roster-fuzzy"), (1, 6): ("new:1", "alias"),
        (2, 1): ("new:1", "new"), (2, 2): ("new:2", "new"), (2, 3): ("new:3", "new"), (2, 4): ("new:1", "exact"), (3, 1): ("e1", "exact"),
    }
    assert R.resolve_in_order(mentions.limit(0), roster, book="book", order="step").collect() == []


def test_names_connect(spark):
    from chronofold.operators.facts import connected

    chain = [(f"n{i:03d}", f"k{j}") for i in range(40) for j in (i, i + 1)] + [("x1", "z"), ("x2", "z"), ("y", None)]
    got = {r.id: r.root for r in connected(spark.createDataFrame(chain, "id string, key string")).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(40)} | {"x1": "x1", "x2": "x1", "y": "y"}
    assert connected(spark.createDataFrame(chain, "id string, key string").where(F.lit(False))).collect() == []
