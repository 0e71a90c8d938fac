"""The story model over the driver's tables.

Each stand-in is one SELECT that both Spark and an ANSI engine read; ``{name}`` marks a
table. ``bind`` makes it a DataFrame; ``PRELUDE`` makes all of them common table
expressions for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NUMBERS = "SELECT doc_id AS n_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS revealed_at FROM {documents}"
RETRACTED = "TIMESTAMP '2024-01-01 00:00:00'"

STANDINS: dict[str, str] = {
    "entities": f"""
SELECT 'c' || CAST(c_custkey AS STRING) AS entity_id, c_name AS canonical_name, 'character' AS type,
       CAST(1 + (c_custkey * 13) % 80 AS INT) AS revealed_at,
       CASE WHEN c_custkey % 7 = 0 THEN CAST(19 + (c_custkey * 13) % 80 AS INT) END AS invalid_at,
       CASE WHEN c_custkey % 17 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{customer}}
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), s_name, 'faction', CAST(1 + (s_suppkey * 7) % 80 AS INT),
       CASE WHEN s_suppkey % 5 = 0 THEN CAST(13 + (s_suppkey * 7) % 80 AS INT) END,
       CASE WHEN s_suppkey % 17 = 0 THEN {RETRACTED} END
FROM {{supplier}}""",
    "edges": f"""
SELECT CAST(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000 AS BIGINT) AS edge_id, 'c' || CAST(o_custkey AS STRING) AS src_entity,
       's' || CAST(l_suppkey AS STRING) AS dst_entity, o_orderpriority AS rel_type, l_linestatus AS label,
       CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) AS INT) AS revealed_at,
       CASE WHEN l_returnflag = 'R' THEN CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) + 6 AS INT) END AS invalid_at,
       CASE WHEN l_orderkey % 97 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "events_": f"""
SELECT o_orderkey AS event_id, o_orderpriority || ' ' || o_orderstatus AS summary, o_orderstatus AS kind,
       CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) AS INT) AS revealed_at,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) + 9 AS INT) END AS invalid_at,
       CASE WHEN o_orderkey % 101 = 0 THEN {RETRACTED} END AS retracted_at,
       CAST(o_orderkey % 7 AS INT) AS order_idx, 'c' || CAST(o_custkey AS STRING) AS hero
FROM {{orders}}""",
    "participants": """
SELECT DISTINCT event_id, entity_id, role, revealed_at FROM (
  SELECT o_orderkey AS event_id, 'c' || CAST(o_custkey AS STRING) AS entity_id, 'buyer' AS role,
         CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) AS INT) AS revealed_at
  FROM {orders}
  UNION ALL
  SELECT l_orderkey, 's' || CAST(l_suppkey AS STRING), 'supplier',
         CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) + l_linenumber % 2 AS INT)
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) u""",
    "states": f"""
SELECT o_orderkey AS state_id, 'c' || CAST(o_custkey AS STRING) AS entity_id,
       '{{{{"status":"' || o_orderstatus || '","rank":' || CAST(o_orderkey % 9 AS STRING) || '}}}}' AS status_json,
       CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) AS INT) AS revealed_at,
       lead(CAST((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) AS INT))
         OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS invalid_at,
       CASE WHEN o_orderkey % 89 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{orders}}""",
    "aliases": f"""
SELECT c_custkey * 2 AS alias_id, 'c' || CAST(c_custkey AS STRING) AS entity_id, upper(c_name) AS surface,
       CAST(1 + (c_custkey * 13) % 80 + c_custkey % 3 AS INT) AS revealed_at,
       CASE WHEN c_custkey % 29 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{customer}}
UNION ALL
SELECT c_custkey * 2 + 1, 'c' || CAST(c_custkey AS STRING), n_name, CAST(c_custkey % 60 + 1 AS INT), CAST(NULL AS TIMESTAMP)
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "themes": f"""
SELECT p_partkey AS theme_id, p_brand AS name, p_type AS description, CAST(1 + p_partkey % 80 AS INT) AS revealed_at,
       CASE WHEN p_partkey % 6 = 0 THEN CAST(11 + p_partkey % 80 AS INT) END AS invalid_at,
       CASE WHEN p_partkey % 31 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{part}}""",
    # Chapters are numbered over narrow rows; the texts join their numbers.
    "chapters": f"""
SELECT source AS book_id, 'd' || CAST(doc_id AS STRING) AS chapter_key, doc_id, revealed_at,
       substring(text, 1, 24) AS title, text, lang AS content_language, n_chars AS char_len,
       substring(sha256(text), 1, 16) AS content_hash, CASE WHEN doc_id % 19 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{documents}} JOIN ({NUMBERS}) numbers ON n_id = doc_id""",
    "receipts": f"""
SELECT source AS book_id, 'd' || CAST(doc_id AS STRING) AS chapter_key, revealed_at AS ordinal,
       CASE WHEN doc_id % 23 = 0 THEN 'stale' ELSE substring(sha256(text), 1, 16) END AS content_hash
FROM {{documents}} JOIN ({NUMBERS}) numbers ON n_id = doc_id WHERE doc_id % 37 <> 0""",
    "summaries": f"""
SELECT doc_id AS summary_id, source AS book_id, 'd' || CAST(doc_id AS STRING) AS chapter_key, 'chapter' AS kind,
       substring(text, 1, 60) AS body, revealed_at, CASE WHEN doc_id % 41 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{documents}} JOIN ({NUMBERS}) numbers ON n_id = doc_id
UNION ALL
SELECT doc_id + 1000000000, source, 'd' || CAST(doc_id AS STRING), 'rolling-recap', substring(text, 5, 60), revealed_at, CAST(NULL AS TIMESTAMP)
FROM {{documents}} JOIN ({NUMBERS}) numbers ON n_id = doc_id""",
    "chunks": f"""
SELECT vec_id AS chunk_id, 'k' || CAST(label AS STRING) || '-' || CAST(vec_id AS STRING) AS chapter_key, embedding AS vec, label + 1 AS revealed_at,
       'model-' || CAST(vec_id % 2 AS STRING) AS model, 64 AS dimension,
       CASE WHEN vec_id % 13 = 0 THEN {RETRACTED} END AS retracted_at
FROM {{embeddings}}""",
    "reports": """
SELECT event_id, user_id AS book_id, ts, event_type AS kind, value AS usd,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM {events}""",
}


def _tables(sql: str) -> list[str]:
    names = "customer supplier nation region part orders lineitem events documents embeddings pages benchmark labels conversations"
    return [n for n in names.split() if "{" + n + "}" in sql]


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in ``name`` over the tables of ``sf_dir``."""
    sql = STANDINS[name].replace("sha256(text)", "sha2(text, 256)")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(sql)})


def _plain(sql: str) -> str:
    for t in _tables(sql):
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{{", "{").replace("}}", "}")


PRELUDE = "WITH " + ",\n".join(f"{name} AS ({_plain(sql)})" for name, sql in STANDINS.items())
