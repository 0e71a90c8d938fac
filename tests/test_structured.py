"""The structured evaluation: every bookmark is read, and rows that repeat count as the SQL counts them."""

import duckdb

from chronofold.plans import registry
from chronofold.plans.queries_views import at
from tests.compare import assert_same
from tests.conftest import TABLES

registry.load()


def test_every_bookmark_is_read(spark, sf):
    got = {r.bm: r.reads for r in registry.QUERIES["eval_structured_all"](spark, sf).collect()}
    assert {b for b in got if b % 8} and set(got) <= set(range(81))
    for b in (9, 23, 37, 43, 79, 80):
        assert got.get(b, 0) == at(spark, sf, b).relationships().count()


def test_repeated_entities_are_read_as_often_as_in_sql(spark, sf, tmp_path):
    duck = duckdb.connect()
    for t in TABLES:
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        if t in ("customer", "supplier"):
            rows = rows.unionByName(rows.limit(40))
        rows.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("eval_structured", "eval_structured_all"):
        assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], duck)
