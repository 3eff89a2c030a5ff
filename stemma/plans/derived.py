"""The registry derived from the driver's tables, as SQL that Spark and DuckDB both run.

Braces name the tables a text reads. ``{ts:...}`` is a timestamp literal without zone.
``seq`` is insertion order; uid is ``<kind>:<key>``; now is 2002-01-01.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NOW, EARLY, MIDDLE = "2002-01-01 00:00:00", "1997-06-01 00:00:00", "1999-06-01 00:00:00"

TABLES = {
    "entities": """
SELECT CAST(r_regionkey AS BIGINT) AS seq, 'region:' || CAST(r_regionkey AS STRING) AS uid, 'organ' AS entity_type, 'active' AS lifecycle_status FROM {region}
UNION ALL SELECT 1000 + n_nationkey, 'nation:' || CAST(n_nationkey AS STRING), 'repo', CASE WHEN n_nationkey % 50 = 49 THEN 'archived' ELSE 'active' END FROM {nation}
UNION ALL SELECT 10000000 + c_custkey, 'customer:' || CAST(c_custkey AS STRING), 'module', CASE WHEN c_acctbal < 0 THEN 'deprecated' WHEN c_custkey % 50 = 49 THEN 'archived' ELSE 'active' END FROM {customer}
UNION ALL SELECT 20000000 + s_suppkey, 'supplier:' || CAST(s_suppkey AS STRING), 'module', CASE WHEN s_suppkey % 50 = 49 THEN 'archived' ELSE 'active' END FROM {supplier}
UNION ALL SELECT 30000000 + p_partkey, 'part:' || CAST(p_partkey AS STRING), 'document', CASE WHEN p_partkey % 50 = 49 THEN 'archived' ELSE 'active' END FROM {part}
UNION ALL SELECT DISTINCT 40000000 + user_id, 'session:' || CAST(user_id AS STRING), 'session', 'active' FROM {events}""",
    "hierarchy_edges": """
SELECT CAST(n_nationkey AS BIGINT) AS seq, 'region:' || CAST(n_regionkey AS STRING) AS parent_id, 'nation:' || CAST(n_nationkey AS STRING) AS child_id, {ts:1995-01-01 00:00:00} AS valid_from, CAST(NULL AS {tstype}) AS valid_to FROM {nation}
UNION ALL SELECT 10000000 + c_custkey, 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), {ts:1995-01-01 00:00:00}, CASE WHEN c_custkey % 7 = 0 THEN {ts:1998-01-01 00:00:00} END FROM {customer}
UNION ALL SELECT 20000000 + c_custkey, 'nation:' || CAST((c_nationkey + 1) % 25 AS STRING), 'customer:' || CAST(c_custkey AS STRING), {ts:1998-01-01 00:00:00}, CAST(NULL AS {tstype}) FROM {customer} WHERE c_custkey % 7 = 0
UNION ALL SELECT 30000000 + s_suppkey, 'nation:' || CAST(s_nationkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), {ts:1995-01-01 00:00:00}, CAST(NULL AS {tstype}) FROM {supplier}
UNION ALL SELECT 40000000 + o_orderkey, 'customer:' || CAST(o_custkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), {ts:1995-01-01 00:00:00}, CAST(NULL AS {tstype}) FROM {orders}""",
    "depends_edges": """
SELECT p_partkey * 4 AS seq, 'part:' || CAST(p_partkey AS STRING) AS source_id, 'part:' || CAST(p_partkey + 1 AS STRING) AS target_id, 'depends_on' AS relation_type, {ts:1995-01-01 00:00:00} AS valid_from, CASE WHEN p_partkey % 35 = 0 THEN {ts:1998-01-01 00:00:00} END AS valid_to
FROM {part} WHERE p_partkey % 6 < 3 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM {part})
UNION ALL SELECT p_partkey * 4 + 1, 'part:' || CAST(p_partkey AS STRING), 'part:' || CAST(p_partkey + 2 AS STRING), 'depends_on', {ts:1995-01-01 00:00:00}, CAST(NULL AS {tstype})
FROM {part} WHERE p_partkey % 6 = 0 AND p_partkey + 2 <= (SELECT max(p_partkey) FROM {part})
UNION ALL SELECT p_partkey * 4 + 2, 'part:' || CAST(p_partkey AS STRING), 'part:' || CAST(p_partkey + 3 AS STRING), 'depends_on', {ts:1995-01-01 00:00:00}, CAST(NULL AS {tstype})
FROM {part} WHERE p_partkey % 12 = 0 AND p_partkey + 3 <= (SELECT max(p_partkey) FROM {part})""",
    "relation_edges": """
SELECT l_suppkey * 1000000 + l_partkey AS seq, 'supplier:' || CAST(l_suppkey AS STRING) AS source_id, 'part:' || CAST(l_partkey AS STRING) AS target_id, 'produces_for' AS relation_type, min(l_shipdate) AS valid_from, CASE WHEN l_partkey % 5 = 0 THEN max(l_shipdate) END AS valid_to
FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "names": """
SELECT 10000000 + c_custkey AS seq, 'customer:' || CAST(c_custkey AS STRING) AS entity_id, c_name AS display_name, CAST(NULL AS STRING) AS slug, {ts:1995-01-01 00:00:00} AS valid_from, CASE WHEN c_custkey % 10 = 0 THEN {ts:1998-01-01 00:00:00} END AS valid_to, c_custkey % 10 <> 0 AS is_primary FROM {customer}
UNION ALL SELECT 20000000 + c_custkey, 'customer:' || CAST(c_custkey AS STRING), c_name || ' Renamed', 'renamed-' || CAST(c_custkey AS STRING), {ts:1998-01-01 00:00:00}, CAST(NULL AS {tstype}), true FROM {customer} WHERE c_custkey % 10 = 0
UNION ALL SELECT 30000000 + c_custkey, 'customer:' || CAST(c_custkey AS STRING), 'Alias ' || c_mktsegment || ' ' || CAST(c_custkey % 20 AS STRING), CAST(NULL AS STRING), {ts:1996-01-01 00:00:00}, CAST(NULL AS {tstype}), false FROM {customer} WHERE c_custkey % 10 = 1
UNION ALL SELECT 40000000 + s_suppkey, 'supplier:' || CAST(s_suppkey AS STRING), s_name, 'vendor-' || CAST(s_suppkey % 500 AS STRING), {ts:1995-01-01 00:00:00}, CAST(NULL AS {tstype}), true FROM {supplier}
UNION ALL SELECT 50000000 + p_partkey, 'part:' || CAST(p_partkey AS STRING), p_name, CAST(NULL AS STRING), {ts:1995-01-01 00:00:00}, CAST(NULL AS {tstype}), true FROM {part}""",
    "observations": """
SELECT event_id AS seq, event_type AS metric_id, 'session:' || CAST(user_id AS STRING) AS entity_id, value, ts FROM {events}
UNION ALL SELECT 1000000000 + o_orderkey, 'total', 'order:' || CAST(o_orderkey AS STRING), o_totalprice, o_orderdate FROM {orders} WHERE o_orderkey % 9 <> 0""",
    "event_log": """
SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'entity.created' WHEN 'click' THEN 'entity.renamed' WHEN 'purchase' THEN 'name.added' WHEN 'error' THEN 'entity.deprecated' ELSE 'entity.archived' END AS event_type,
  'session:' || CAST(user_id AS STRING) AS subject_entity, CASE event_id % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'module' ELSE 'unheard-of' END AS entity_type, 'Name ' || CAST(event_id AS STRING) AS new_value, ts FROM {events}""",
    "state_requests": """
SELECT 'order:' || CAST(o_orderkey AS STRING) AS request_id, 'customer:' || CAST(o_custkey AS STRING) AS entity_id, o_orderdate AS asked_at FROM {orders}
UNION ALL SELECT DISTINCT 'shipped:' || CAST(l_suppkey AS STRING) || ':' || CAST(CAST(l_shipdate AS DATE) AS STRING), 'supplier:' || CAST(l_suppkey AS STRING), l_shipdate FROM {lineitem}""",
    "lineage": """
SELECT p_partkey AS seq, 'part:' || CAST(p_partkey AS STRING) AS entity_id, 'part:' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS related_id,
  CASE p_partkey % 4 WHEN 0 THEN 'derived_from' WHEN 1 THEN 'split_from' WHEN 2 THEN 'derived_from' ELSE 'merged_into' END AS lineage_type FROM {part} WHERE p_partkey >= 1
UNION ALL SELECT 100000000 + p_partkey, 'part:' || CAST(p_partkey + 1 AS STRING), 'part:' || CAST(p_partkey AS STRING), 'supersedes' FROM {part} WHERE p_partkey % 8 = 3""",
    "recovery_expected": """
SELECT DISTINCT 'session:' || CAST(CASE WHEN user_id % 10 = 7 THEN -user_id ELSE user_id END AS STRING) AS uid, CASE WHEN user_id % 6 = 0 THEN 'module' ELSE 'session' END AS entity_type, CASE WHEN user_id % 4 = 0 THEN 'archived' ELSE 'active' END AS lifecycle_status FROM {events}""",
    "snapshot_before": "SELECT 'part:' || CAST(p_partkey AS STRING) AS entity_id, p_size AS size, p_retailprice AS price, p_type AS kind FROM {part} WHERE p_partkey % 17 <> 0",
    "snapshot_after": """SELECT 'part:' || CAST(p_partkey AS STRING) AS entity_id, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS size,
  CASE WHEN p_partkey % 11 = 0 THEN p_retailprice + 10 ELSE p_retailprice END AS price, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END AS kind FROM {part} WHERE p_partkey % 13 <> 0""",
    "artifacts": """
SELECT 'part:' || CAST(p_partkey AS STRING) AS artifact_id,
  CASE p_partkey % 5 WHEN 0 THEN 'sort' WHEN 1 THEN 'validate' WHEN 2 THEN 'classify' WHEN 3 THEN 'store' ELSE 'govern' END AS function,
  CASE p_partkey % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'repo' WHEN 2 THEN 'credential' WHEN 3 THEN 'document' WHEN 4 THEN 'prompt' WHEN 5 THEN 'atom' END AS material,
  CASE p_partkey % 4 WHEN 0 THEN 'daemon' WHEN 1 THEN 'cli' WHEN 2 THEN 'api' ELSE 'config-file' END AS pattern,
  CASE p_partkey % 3 WHEN 0 THEN 'personal' WHEN 1 THEN 'organ' ELSE 'system' END AS scope,
  CASE WHEN p_partkey % 23 = 0 THEN 'secret' WHEN p_partkey % 29 = 0 THEN 'sovereign' ELSE 'public' END AS security FROM {part}""",
    "rule_table": """
SELECT CAST(p_partkey AS BIGINT) AS place, p_partkey * 10 AS rule_id, 'shelf-' || CAST(p_partkey AS STRING) || '/' AS target,
  CASE WHEN p_partkey % 2 = 1 THEN CASE CAST(floor(p_partkey / 3) AS BIGINT) % 6 WHEN 0 THEN 'sort' WHEN 1 THEN 'validate' WHEN 2 THEN 'classify' WHEN 3 THEN 'store' WHEN 4 THEN 'govern' ELSE 'dream' END END AS function,
  CASE WHEN CAST(floor(p_partkey / 2) AS BIGINT) % 3 > 0 THEN CASE CAST(floor(p_partkey / 5) AS BIGINT) % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'repo' WHEN 2 THEN 'credential' WHEN 3 THEN 'document' ELSE 'atom' END END AS material,
  CASE WHEN CAST(floor(p_partkey / 4) AS BIGINT) % 2 = 1 THEN CASE CAST(floor(p_partkey / 7) AS BIGINT) % 3 WHEN 0 THEN 'daemon' WHEN 1 THEN 'cli' ELSE 'api' END END AS pattern,
  CASE WHEN p_partkey % 11 > 2 THEN CASE p_partkey % 3 WHEN 0 THEN 'personal' WHEN 1 THEN 'organ' ELSE 'system' END END AS scope,
  CASE WHEN p_partkey % 13 > 4 THEN CASE WHEN p_partkey % 7 = 0 THEN 'sovereign' ELSE 'public' END END AS security FROM {part} WHERE p_partkey % 11 > 2 OR p_partkey % 13 > 4""",
    "policy_table": """
SELECT 'pol:' || CAST(p_partkey AS STRING) AS policy_id, 'note' AS action, CAST(p_partkey % 5 AS INT) AS priority, CASE p_partkey % 4 WHEN 0 THEN 'module' WHEN 1 THEN 'repo' END AS scope, p_partkey % 10 <> 9 AS enabled FROM {part}""",
    "policy_conditions": """
SELECT 'pol:' || CAST(p_partkey AS STRING) AS policy_id, 0 AS k, 'balance' AS field, 'gt' AS operator, CAST(p_partkey * 37 % 11000 - 1000 AS DOUBLE) AS number, CAST(NULL AS STRING) AS text FROM {part}
UNION ALL SELECT 'pol:' || CAST(p_partkey AS STRING), 1, 'balance', 'lt', CAST(p_partkey * 37 % 11000 - 900 + p_partkey % 7 * 40 AS DOUBLE), CAST(NULL AS STRING) FROM {part}
UNION ALL SELECT 'pol:' || CAST(p_partkey AS STRING), 2, 'segment', 'in', CAST(NULL AS DOUBLE), 'BUILDING,MACHINERY,AUTOMOBILE' FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT 'pol:' || CAST(p_partkey AS STRING), 3, 'nation', 'ne', CAST(p_partkey % 25 AS DOUBLE), CAST(NULL AS STRING) FROM {part} WHERE p_partkey % 5 = 0""",
    "signals": """
SELECT event_id AS seq, CASE WHEN event_id % 10 = 9 THEN '' ELSE 'session:' || CAST(user_id AS STRING) END AS entity_id,
  CASE event_id % 8 WHEN 0 THEN 'file_modified' WHEN 1 THEN 'git_commit' WHEN 2 THEN 'git_branch_created' WHEN 3 THEN 'edge_added' WHEN 4 THEN 'content_drift' WHEN 5 THEN 'metric_spike' WHEN 6 THEN 'promotion_changed' ELSE 'unheard_of' END AS signal_type,
  'sensor-' || event_type AS sensor_name, value FROM {events}""",
    "variables": """
SELECT p_partkey AS seq, 'key' || CAST(p_partkey % 10 AS STRING) AS key, CASE p_partkey % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'organ' WHEN 2 THEN 'repo' ELSE 'module' END AS scope,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'region:' || CAST(p_partkey % 5 AS STRING) WHEN 2 THEN 'nation:' || CAST(p_partkey % 25 AS STRING) ELSE 'customer:' || CAST(p_partkey % 150 AS STRING) END AS entity_id,
  p_name AS value, CASE WHEN p_partkey % 3 = 0 THEN 'constant' ELSE 'runtime' END AS mutability FROM {part}""",
}

_NEED = {name: sorted(set(re.findall(r"\{(\w+)\}", text)) - {"tstype"}) for name, text in TABLES.items()}


def _text(name: str, literal: str, kind: str) -> str:
    return re.sub(r"\{ts:([^}]*)\}", literal, TABLES[name]).replace("{tstype}", kind)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame over the Parquet tables it reads."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _NEED[name]}
    if name == "state_requests":
        return _state_requests(**tables)
    return by_text(spark, name, tables)


def by_text(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A derived table by its text, over the tables it names."""
    return spark.sql(_text(name, r"CAST('\1' AS TIMESTAMP_NTZ)", "TIMESTAMP_NTZ"), **tables)


def _state_requests(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The rows of the text. Shipments' texts are made of a supplier's number and a time, so those are told apart and texts made of what is left.

    Few shipments share both, so they are dealt first: what a task tells apart then is small. Equal ones are streamed by, not kept.
    """
    text = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
    ordered = orders.select(text("order", "o_orderkey").alias("request_id"), text("customer", "o_custkey").alias("entity_id"), F.col("o_orderdate").alias("asked_at"))
    days = lineitem.select("l_suppkey", "l_shipdate").repartition("l_suppkey", "l_shipdate").distinct()
    shipped = F.concat(text("shipped", "l_suppkey"), F.lit(":"), F.col("l_shipdate").cast("date").cast("string"))
    return ordered.union(days.select(shipped, text("supplier", "l_suppkey"), "l_shipdate"))


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, after WITH clauses for the derived tables it names; a text that starts with RECURSIVE continues them."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({re.sub(r'[{](?!ts)(\w+)[}]', r'\1', _text(n, r"CAST('\1' AS TIMESTAMP)", 'TIMESTAMP')).replace('AS STRING', 'AS VARCHAR')})" for n in used]
    recursive = sql.lstrip().startswith("RECURSIVE")
    body = re.sub(r"^\s*(RECURSIVE|WITH)\b", "", sql)
    more = body is not sql and body != sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(heads) + (", " if more and heads else " ") + body
