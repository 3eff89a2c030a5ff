"""The engine's queries over the derived registry, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import graph, metrics, mutate, resolve, rules, sensing, state, temporal
from ..registry import Registry, open_store
from ..session import numbered, shared_folder
from ..sources import law, store
from ..sources.store import Store
from .derived import EARLY, MIDDLE, NOW, derived, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: "Active" in DuckDB.
ACT = "(valid_from <= TIMESTAMP '{0}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{0}'))".format
PARENT = "parent AS (SELECT child_id, arg_max(parent_id, seq) AS parent_id FROM hierarchy_edges WHERE {} GROUP BY child_id)".format
NAMED = "named AS (SELECT entity_id, arg_max(display_name, (CASE WHEN is_primary THEN 1000000000000 ELSE 0 END) + seq) AS display_name, bool_or(is_primary) AS is_primary FROM names WHERE {} GROUP BY entity_id)".format
SLUGGED = r"trim(regexp_replace(regexp_replace(lower(display_name), '[^a-z0-9-]+', '-', 'g'), '-{3,}', '--', 'g'), '-')"
SLUG = f"coalesce(slug, {SLUGGED})"
#: A routing law over the columns of ``artifacts``, as the text that a deployment would keep in a file. The first match wins;
#: rule 8 names a column that isn't a dimension and so never matches, and what no rule takes goes to the fallback.
LAW = """
version: 3
rules:
  - id: 2
    match:
      pattern: config-file
      security: public
    target: settings/
  - id: 3
    match:
      material: repo
      scope: organ
    target: projects/
  - id: 4
    match:
      function: store
      pattern: daemon
    target: warehouse/
  - id: 5
    match:
      material: document
      function: sort
    target: 'shelf/'
  - id: 6
    match:
      scope: personal
      function: govern
    target: notes/
  - id: 7
    match:
      pattern: api
      scope: organ
      security: sovereign
    target: gateway/
  - id: 8
    match:
      colour: red
    target: nowhere/
  - id: 9
    match:
      material: credential
      pattern: cli
      function: validate
    target: probes/   # three keys
  - id: 10
    match:
      security: secret
    target: locked/
  - id: 11
    match:
      material: prompt
    target: drafts/
"""
RULES = law.parse(LAW)["rules"]
FALLBACK = "unsorted/"
POLICIES = [
    {"policy_id": "p-inactive", "action": "flag", "priority": 5, "conditions": [("lifecycle_status", "ne", "active")]},
    {"policy_id": "p-module", "action": "review", "priority": 9, "scope": "module", "conditions": [("lifecycle_status", "in", ["deprecated", "archived"])]},
    {"policy_id": "p-always", "action": "log", "priority": 1, "scope": "organ", "conditions": []},
    {"policy_id": "p-off", "action": "log", "priority": 99, "enabled": False, "conditions": []},
    {"policy_id": "p-uid", "action": "note", "priority": 5, "conditions": [("uid", "contains", "7"), ("lifecycle_status", "eq", "archived")]},
]


def query(name: str, sql: str | None = None, raw: bool = False):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql if raw else oracle(sql)
        return f

    return add


def _t(*names: str):
    """A query of the derived tables named, which are its arguments."""

    def wrap(f):
        return lambda spark, sf_dir: f(*[derived(spark, sf_dir, n) for n in names])

    return wrap


def _one(df: DataFrame, column: str, *values: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")


# Filters, latest rows, ranges


@query("f1_asof_edges", f"SELECT seq, parent_id, child_id FROM hierarchy_edges WHERE {ACT(EARLY)}")
@_t("hierarchy_edges")
def _(edges):
    return temporal.as_of(edges, EARLY).select("seq", "parent_id", "child_id")


@query("f2_list_entities", "SELECT seq, uid FROM entities WHERE entity_type = 'module' AND lifecycle_status = 'deprecated'")
@_t("entities")
def _(e):
    return e.where("entity_type = 'module' and lifecycle_status = 'deprecated'").select("seq", "uid")


@query("f4_obs_range", "SELECT seq, entity_id, value FROM observations WHERE metric_id = 'total' AND ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts <= TIMESTAMP '1998-06-01 00:00:00' ORDER BY seq DESC LIMIT 1000")
@_t("observations")
def _(o):
    return metrics.query(o, "total", None, "1996-01-01 00:00:00", "1998-06-01 00:00:00", 1000).select("seq", "entity_id", "value")


@query("f5_replay_tail", "SELECT seq, subject_entity FROM event_log WHERE event_type = 'entity.renamed' AND ts > (SELECT min(ts) FROM event_log) ORDER BY seq DESC LIMIT 500")
@_t("event_log")
def _(ev):
    first = ev.agg(F.min("ts").cast("string")).first()[0]
    return metrics.replay(ev, first, "entity.renamed", None, 500).select("seq", "subject_entity")


@query("w1_current_name", f"WITH {NAMED(ACT(NOW))} SELECT entity_id, display_name, is_primary FROM named")
@_t("names")
def _(n):
    return temporal.current_name(n, NOW)


@query("w2_latest", "SELECT metric_id, entity_id, arg_max(value, seq) AS value FROM observations GROUP BY metric_id, entity_id")
@_t("observations")
def _(o):
    return metrics.latest(o)


@query("w4_time_series", "SELECT seq, value FROM observations WHERE metric_id = 'click' AND entity_id = 'session:7'")
@_t("observations")
def _(o):
    return metrics.time_series(o, "click", "session:7").select("seq", "value")


@query("w5_scd2_names", "SELECT seq, entity_id, CAST(CASE WHEN is_primary THEN lead(valid_from) OVER (PARTITION BY entity_id, is_primary ORDER BY seq) END AS VARCHAR) AS valid_to FROM names")
@_t("names")
def _(n):
    return temporal.rotate_primary(n.drop("valid_to")).select("seq", "entity_id", F.col("valid_to").cast("string").alias("valid_to"))


@query("j2_parent_asof", f"WITH {PARENT(ACT(NOW))} SELECT child_id, parent_id FROM parent")
@_t("hierarchy_edges")
def _(edges):
    return temporal.parent_of(edges, NOW)


@query("j3_incoming_relations", f"SELECT target_id AS entity_id, source_id AS other_id, relation_type FROM relation_edges WHERE {ACT(MIDDLE)} AND relation_type = 'produces_for'")
@_t("relation_edges")
def _(r):
    return temporal.relations_of(r, MIDDLE, "produces_for", incoming=True).select("entity_id", "other_id", "relation_type")


_STATE = f"""WITH {PARENT(ACT(MIDDLE))}, {NAMED(ACT(MIDDLE))},
kids AS (SELECT parent_id AS uid, count(*) AS n FROM hierarchy_edges WHERE {ACT(MIDDLE)} GROUP BY 1),
og AS (SELECT source_id AS uid, count(*) AS n FROM relation_edges WHERE {ACT(MIDDLE)} GROUP BY 1),
ic AS (SELECT target_id AS uid, count(*) AS n FROM relation_edges WHERE {ACT(MIDDLE)} GROUP BY 1)
SELECT e.uid, e.entity_type, e.lifecycle_status, named.display_name AS primary_name, parent.parent_id, coalesce(kids.n, 0) AS child_count, coalesce(og.n, 0) AS outgoing_count, coalesce(ic.n, 0) AS incoming_count
FROM entities e LEFT JOIN named ON named.entity_id = e.uid LEFT JOIN parent ON parent.child_id = e.uid LEFT JOIN kids ON kids.uid = e.uid LEFT JOIN og ON og.uid = e.uid LEFT JOIN ic ON ic.uid = e.uid"""


@query("j14_entity_state_asof", _STATE)
@_t("entities", "names", "hierarchy_edges", "relation_edges")
def _(e, n, h, r):
    return temporal.entity_state(e, n, h, r, MIDDLE)


@query("j5_orphans", f"SELECT uid, entity_type FROM entities WHERE lifecycle_status = 'active' AND uid NOT IN (SELECT parent_id FROM hierarchy_edges WHERE {ACT(NOW)}) AND uid NOT IN (SELECT child_id FROM hierarchy_edges WHERE {ACT(NOW)})")
@_t("entities", "hierarchy_edges")
def _(e, h):
    return state.orphans(e, h, NOW)


# Aggregates


def _rollup_query(policy: str) -> None:
    pick = {"sum": "sum(value)", "avg": "avg(value)", "max": "max(value)", "min": "min(value)", "count": "count(*)::DOUBLE", "latest": "arg_max(value, seq)"}[policy]
    latest = "o AS (SELECT entity_id, arg_max(value, seq) AS value FROM observations WHERE metric_id = 'total' GROUP BY 1)"

    @query(f"a2_rollup_{policy}", f"WITH {latest} SELECT parent_id AS entity_id, count(*) AS child_count, round({pick}, 4) AS value FROM hierarchy_edges h JOIN o ON o.entity_id = h.child_id WHERE {ACT(NOW)} GROUP BY 1")
    @_t("hierarchy_edges", "observations")
    def _(h, o):
        return metrics.rollup(h, o, "total", NOW, [policy]).select("entity_id", "child_count", F.round(policy, 4).alias("value"))

    over = {"sum": "sum(v)", "avg": "avg(v)", "max": "max(v)", "min": "min(v)", "count": "count(*)::DOUBLE", "latest": "arg_max(v, seq)"}[policy]
    step = lambda name, src, join: f"{name} AS (SELECT h.parent_id AS uid, count(*) AS n, {over} AS v FROM (SELECT a.parent_id, a.seq, {src} AS v FROM act a {join}) h GROUP BY 1)"
    tree = f"""WITH {latest}, act AS (SELECT * FROM hierarchy_edges WHERE {ACT(NOW)}),
{step('cust', 'coalesce(o.value, 0)', "LEFT JOIN o ON o.entity_id = a.child_id WHERE a.child_id LIKE 'order:%'")},
{step('nat', 'coalesce(c.v, 0)', "LEFT JOIN cust c ON c.uid = a.child_id WHERE a.parent_id LIKE 'nation:%'")},
{step('reg', 'coalesce(c.v, 0)', "LEFT JOIN nat c ON c.uid = a.child_id WHERE a.parent_id = 'region:1'")},
mine AS (SELECT child_id FROM act WHERE parent_id = 'region:1'),
own AS (SELECT child_id FROM act WHERE parent_id IN (SELECT child_id FROM mine))
SELECT uid AS entity_id, n AS child_count, round(v, 4) AS value FROM reg UNION ALL SELECT uid, n, round(v, 4) FROM nat WHERE uid IN (SELECT child_id FROM mine) UNION ALL SELECT uid, n, round(v, 4) FROM cust WHERE uid IN (SELECT child_id FROM own)"""

    @query(f"a3_rollup_tree_{policy}", tree)
    @_t("hierarchy_edges", "observations")
    def _(h, o):
        return metrics.rollup_tree(h, o, "total", "region:1", NOW, [policy]).select("entity_id", "child_count", F.round(policy, 4).alias("value"))


for _p in ("sum", "avg", "max", "min", "count", "latest"):
    _rollup_query(_p)


@query("a4_subtree_size", f"RECURSIVE act AS (SELECT * FROM hierarchy_edges WHERE {ACT(NOW)}), below AS (SELECT parent_id AS root, child_id AS node FROM act UNION SELECT root, child_id FROM below JOIN act ON parent_id = node) SELECT root, count(*) AS size FROM below GROUP BY 1")
@_t("hierarchy_edges")
def _(h):
    roots = temporal.as_of(h, NOW).select(F.col("parent_id").alias("root"))
    return graph.macro_descent(h, roots, NOW).groupBy("root").agg(F.countDistinct("node").alias("size"))


@query("a5_runtime_counts", "SELECT 'entity_type' AS dimension, entity_type AS value, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'lifecycle_status', lifecycle_status, count(*) FROM entities GROUP BY 2")
@_t("entities")
def _(e):
    return state.runtime_counts(e)


@query("a6_runtime_summary", f"SELECT (SELECT count(*) FROM entities) AS total_entities, (SELECT count(*) FROM entities WHERE lifecycle_status = 'active') AS active_entities, (SELECT count(*) FROM hierarchy_edges WHERE {ACT(NOW)}) AS active_hierarchy, (SELECT count(*) FROM relation_edges WHERE {ACT(NOW)}) AS active_relations")
@_t("entities", "hierarchy_edges", "relation_edges")
def _(e, h, r):
    return state.runtime_summary(e, h, r, NOW)


@query("a7_overcoupling", f"SELECT target_id, count(*) AS incoming, least(1.0::DOUBLE, count(*) / 50.0::DOUBLE) AS severity FROM relation_edges WHERE {ACT(NOW)} GROUP BY 1 HAVING count(*) >= 25")
@_t("relation_edges")
def _(r):
    return state.overcoupling(r, NOW, 25)


@query("a8_naming_conflicts", f"SELECT slug, count(*) AS entity_count, array_to_string(list_sort(list(entity_id)), ',') AS ids FROM (SELECT DISTINCT {SLUG} AS slug, entity_id FROM names WHERE {ACT(NOW)}) GROUP BY 1 HAVING count(*) > 1")
@_t("names")
def _(n):
    return state.naming_conflicts(n, NOW).select("slug", "entity_count", F.array_join("entity_ids", ",").alias("ids"))


_CLUSTERS = f"""RECURSIVE act AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM depends_edges WHERE {ACT(NOW)}),
both_ways AS (SELECT a, b FROM act UNION SELECT b, a FROM act),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
size AS (SELECT component, count(*) AS n FROM comp GROUP BY 1),
pairs AS (SELECT c.component, count(*) AS p FROM act JOIN comp c ON c.node = act.a WHERE act.a <> act.b GROUP BY 1)
SELECT s.component, s.n AS size, round(p / (n * (n - 1) / 2), 6) AS cohesion FROM size s JOIN pairs USING (component) WHERE n >= 2"""


@query("a9_clusters", _CLUSTERS)
@_t("depends_edges")
def _(r):
    return graph.clusters(r, NOW).select("component", "size", F.round("cohesion", 6).alias("cohesion"))


@query("a11_entity_count", "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(DISTINCT entity_id) FROM names) AS named, (SELECT count(*) FROM observations) AS observations")
@_t("entities", "names", "observations")
def _(e, n, o):
    return e.agg(F.count("*").alias("entities")).crossJoin(n.agg(F.countDistinct("entity_id").alias("named"))).crossJoin(o.agg(F.count("*").alias("observations")))


# Sets and diffs


@query("x1_roots", f"SELECT DISTINCT parent_id AS uid FROM hierarchy_edges WHERE {ACT(NOW)} EXCEPT SELECT child_id FROM hierarchy_edges WHERE {ACT(NOW)}")
@_t("hierarchy_edges")
def _(h):
    return graph.roots_of(h, NOW)


@query("x1_leaves", f"SELECT DISTINCT child_id AS uid FROM hierarchy_edges WHERE {ACT(NOW)} EXCEPT SELECT parent_id FROM hierarchy_edges WHERE {ACT(NOW)}")
@_t("hierarchy_edges")
def _(h):
    return graph.leaves_of(h, NOW)


def _side(t: str, n: str) -> str:
    return f"{n}k AS (SELECT DISTINCT parent_id AS uid, child_id AS x FROM hierarchy_edges WHERE {ACT(t)}), {n}r AS (SELECT DISTINCT source_id AS uid, target_id || '|' || relation_type AS x FROM relation_edges WHERE {ACT(t)}), {n}p AS (SELECT child_id AS uid, arg_max(parent_id, seq) AS p FROM hierarchy_edges WHERE {ACT(t)} GROUP BY 1)"


_DIFF = f"""WITH {_side(EARLY, 'a')}, {_side(MIDDLE, 'b')},
ka AS (SELECT uid, array_to_string(list_sort(list(x)), ',') AS v FROM (FROM bk EXCEPT FROM ak) GROUP BY 1), kr AS (SELECT uid, array_to_string(list_sort(list(x)), ',') AS v FROM (FROM ak EXCEPT FROM bk) GROUP BY 1),
ra AS (SELECT uid, array_to_string(list_sort(list(x)), ',') AS v FROM (FROM br EXCEPT FROM ar) GROUP BY 1), rr AS (SELECT uid, array_to_string(list_sort(list(x)), ',') AS v FROM (FROM ar EXCEPT FROM br) GROUP BY 1),
pp AS (SELECT uid, ap.p AS a, bp.p AS b FROM ap FULL JOIN bp USING (uid) WHERE ap.p IS DISTINCT FROM bp.p),
ids AS (SELECT uid FROM ka UNION SELECT uid FROM kr UNION SELECT uid FROM ra UNION SELECT uid FROM rr UNION SELECT uid FROM pp)
SELECT uid, pp.a AS parent_before, pp.b AS parent_after, coalesce(ka.v, '') AS children_added, coalesce(kr.v, '') AS children_removed, coalesce(ra.v, '') AS relations_added, coalesce(rr.v, '') AS relations_removed
FROM ids LEFT JOIN ka USING (uid) LEFT JOIN kr USING (uid) LEFT JOIN ra USING (uid) LEFT JOIN rr USING (uid) LEFT JOIN pp USING (uid)"""


@query("x2_structural_diff", _DIFF)
@_t("hierarchy_edges", "relation_edges")
def _(h, r):
    d = temporal.structural_diff(h, r, EARLY, MIDDLE)
    return d.select("uid", "parent_before", "parent_after", *[F.array_join(c, ",").alias(c) for c in d.columns[3:]])


@query("x7_ids_by_slug", f"SELECT slug AS key, entity_id, min(seq) AS seq FROM (SELECT {SLUG} AS slug, entity_id, seq FROM names) GROUP BY 1, 2")
@_t("names")
def _(n):
    return resolve.by_key(n, "slug")


# Scalars


@query("c1_slugify", f"SELECT seq, {SLUGGED} AS slug FROM names")
@_t("names")
def _(n):
    return n.select("seq", fn.slugify(F.col("display_name")).alias("slug"))


@query("c9_anomaly", "SELECT seq, least(1.0::DOUBLE, abs(value - 50.0::DOUBLE) / 60.0::DOUBLE) AS confidence FROM observations WHERE value < 20 OR value > 80")
@_t("observations")
def _(o):
    c = fn.anomaly_confidence(F.col("value"), F.lit(20.0), F.lit(80.0))
    return o.select("seq", c.alias("confidence")).where("confidence is not null")


@query("c10_constraints", "SELECT p_partkey, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'allowed_values' WHEN p_size < 10 THEN 'min_value' WHEN p_size > 40 THEN 'max_value' END AS broken FROM part", raw=True)
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    brand = fn.violates(F.col("p_brand"), allowed=["Brand#11", "Brand#12", "Brand#13"])
    return p.select("p_partkey", F.coalesce(brand, fn.violates(F.col("p_size").cast("string"), least=10, most=40)).alias("broken"))


_CHANGE = "CASE signal_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.SIGNAL_CHANGES.items()) + " END"


@query("c11_normalize", f"SELECT * FROM (SELECT seq, entity_id, {_CHANGE} AS change_type, sensor_name AS source_sensor FROM signals WHERE entity_id <> '') WHERE change_type IS NOT NULL")
@_t("signals")
def _(s):
    return rules.normalize(s).select("seq", "entity_id", "change_type", "source_sensor")


# Graphs

_TREE = f"""RECURSIVE act AS (SELECT parent_id, child_id FROM hierarchy_edges WHERE {ACT(NOW)}),
walk AS (SELECT child_id AS node, 1 AS depth FROM act WHERE parent_id = 'region:2' UNION SELECT a.child_id, w.depth + 1 FROM walk w JOIN act a ON a.parent_id = w.node WHERE w.depth < {{}})
SELECT node, min(depth) AS depth FROM walk GROUP BY 1"""


@query("g1_macro_descent", _TREE.format(50))
@_t("hierarchy_edges")
def _(h):
    return graph.macro_descent(h, _one(h, "root", "region:2"), NOW).select("node", "depth")


@query("g1_macro_descent_depth2", _TREE.format(2))
@_t("hierarchy_edges")
def _(h):
    return graph.macro_descent(h, _one(h, "root", "region:2"), NOW, 2).select("node", "depth")


@query("g2_micro_ascent", f"RECURSIVE {PARENT(ACT(NOW))}, up AS (SELECT child_id AS node, parent_id AS ancestor, 1 AS distance FROM parent UNION ALL SELECT u.node, p.parent_id, u.distance + 1 FROM up u JOIN parent p ON p.child_id = u.ancestor) SELECT node, ancestor, distance FROM up")
@_t("hierarchy_edges")
def _(h):
    return graph.micro_ascent(h, NOW).select("node", "ancestor", "distance")


_DEP = f"""RECURSIVE act AS (SELECT source_id, target_id FROM depends_edges WHERE {ACT(NOW)}),
walk AS (SELECT {{0}} AS root, {{1}} AS node, 1 AS depth FROM act UNION SELECT w.root, a.{{1}}, w.depth + 1 FROM walk w JOIN act a ON a.{{0}} = w.node WHERE w.depth < 10)
SELECT root, node, min(depth) AS depth FROM walk WHERE root <> node GROUP BY 1, 2"""


@query("g3_dependency_trace", _DEP.format("source_id", "target_id"))
@_t("depends_edges")
def _(r):
    return graph.dependency_trace(r, r.select(F.col("source_id").alias("root")), NOW).select("root", "node", "depth")


@query("g4_reverse_dependency", _DEP.format("target_id", "source_id"))
@_t("depends_edges")
def _(r):
    return graph.dependency_trace(r, r.select(F.col("target_id").alias("root")), NOW, reverse=True).select("root", "node", "depth")


_BLAST = f"""RECURSIVE {PARENT(ACT(NOW))}, h AS (SELECT parent_id, child_id FROM hierarchy_edges WHERE {ACT(NOW)}), r AS (SELECT DISTINCT source_id, target_id FROM relation_edges WHERE {ACT(NOW)}),
seeds AS (SELECT * FROM (VALUES ('nation:3'), ('part:5'), ('customer:11')) t(root)),
up AS (SELECT root, parent_id AS node, 1 AS d FROM seeds JOIN parent ON child_id = root UNION SELECT root, parent_id, d + 1 FROM up JOIN parent ON child_id = node WHERE d < 3),
down AS (SELECT root, child_id AS node, 1 AS d FROM seeds JOIN h ON parent_id = root UNION SELECT root, child_id, d + 1 FROM down JOIN h ON parent_id = node WHERE d < 3),
side AS (SELECT root, source_id AS node, 1 AS d FROM seeds JOIN r ON target_id = root UNION SELECT root, source_id, d + 1 FROM side JOIN r ON target_id = node WHERE d < 3)
SELECT root, node, 'upward' AS direction, min(d) AS distance FROM up GROUP BY 1, 2 UNION ALL SELECT root, node, 'downward', min(d) FROM down GROUP BY 1, 2 UNION ALL SELECT root, node, 'lateral', min(d) FROM side GROUP BY 1, 2"""


@query("g10_blast_radius", _BLAST)
@_t("hierarchy_edges", "relation_edges")
def _(h, r):
    return graph.blast_radius(h, r, _one(h, "root", "nation:3", "part:5", "customer:11"), NOW).select("root", "node", "direction", "distance")


@query("g13_ancestry", "RECURSIVE p AS (SELECT entity_id, arg_min(related_id, seq) AS prev FROM lineage WHERE lineage_type IN ('derived_from', 'split_from') GROUP BY 1), up AS (SELECT entity_id AS node, prev AS ancestor, 1 AS distance FROM p UNION ALL SELECT node, prev, distance + 1 FROM up JOIN p ON p.entity_id = ancestor WHERE distance < 10) SELECT node, ancestor, distance FROM up")
@_t("lineage")
def _(ln):
    return graph.trace_ancestry(ln).select("node", "ancestor", "distance")


@query("l1_predecessors", "SELECT entity_id, related_id AS predecessor, lineage_type FROM lineage WHERE lineage_type IN ('derived_from', 'split_from')")
@_t("lineage")
def _(ln):
    return graph.predecessors(ln).drop("seq")


@query("l2_successors", "SELECT entity_id, related_id AS successor, lineage_type FROM lineage WHERE lineage_type = 'merged_into' UNION ALL SELECT related_id, entity_id, lineage_type FROM lineage WHERE lineage_type = 'supersedes'")
@_t("lineage")
def _(ln):
    return graph.successors(ln).drop("seq")


@query("l3_full_lineage", "SELECT entity_id AS \"of\", entity_id, related_id, lineage_type FROM lineage UNION ALL SELECT related_id, entity_id, related_id, lineage_type FROM lineage")
@_t("lineage")
def _(ln):
    return graph.full_lineage(ln).drop("seq")


# Resolution

_WANTED = "(VALUES ('customer:3'), ('Customer#000000010'), ('customer-000000010-renamed'), ('renamed-10'), ('vendor-3'), ('supplier-000000003'), ('CUSTOMER#000000010 RENAMED'), ('alias-building-1'), ('Alias BUILDING 1'), ('no such thing'), ('customer-000000020'), ('Supplier#000000002')) w(identifier)"
_CAND = f"""{NAMED(ACT(NOW))}, keys AS (SELECT {SLUG} AS slug, lower(display_name) AS lowered, entity_id, min(seq) AS seq FROM names GROUP BY 1, 2, 3),
d AS (SELECT identifier, entity_id AS uid, min(keys.seq) AS seq FROM {_WANTED} JOIN keys ON lowered = lower(identifier) JOIN entities ON uid = entity_id GROUP BY 1, 2),
s AS (SELECT identifier, entity_id AS uid, min(keys.seq) AS seq FROM {_WANTED} JOIN keys ON slug = identifier JOIN entities ON uid = entity_id GROUP BY 1, 2),
c AS (SELECT identifier, uid, 'uid' AS matched_by, 1 AS r, CAST(0 AS BIGINT) AS seq FROM {_WANTED} JOIN entities ON uid = identifier
 UNION ALL SELECT identifier, uid, 'primary_name', 2, seq FROM d JOIN named n ON n.entity_id = uid WHERE n.is_primary AND lower(n.display_name) = lower(identifier)
 UNION ALL SELECT identifier, uid, 'slug', 3, seq FROM s UNION ALL SELECT identifier, uid, 'alias', 4, seq FROM d)"""


def _wanted(df: DataFrame) -> DataFrame:
    return _one(df, "identifier", "customer:3", "Customer#000000010", "customer-000000010-renamed", "renamed-10", "vendor-3", "supplier-000000003", "CUSTOMER#000000010 RENAMED", "alias-building-1", "Alias BUILDING 1", "no such thing", "customer-000000020", "Supplier#000000002")


@query("r3_resolve", f"WITH {_CAND} SELECT identifier, uid, matched_by, display_name FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY r, seq) AS k FROM c) LEFT JOIN named ON entity_id = uid WHERE k = 1")
@_t("entities", "names")
def _(e, n):
    return resolve.resolve(_wanted(e), e, n, NOW)


@query("r4_resolve_all", f"WITH {_CAND}, o AS (SELECT identifier, uid, matched_by, CASE r WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS r, seq FROM c WHERE r <> 2), u AS (SELECT *, row_number() OVER (PARTITION BY identifier, uid ORDER BY r, seq) AS k FROM o) SELECT identifier, uid, matched_by, row_number() OVER (PARTITION BY identifier ORDER BY r, seq) AS place FROM u WHERE k = 1")
@_t("entities", "names")
def _(e, n):
    return resolve.resolve_all(_wanted(e), e, n, NOW)


# Replay, snapshots, signatures


@query("t5_recover", """WITH rows AS (SELECT * FROM event_log WHERE seq < coalesce((SELECT min(seq) FROM event_log WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM event_log)), 9999999999)),
born AS (SELECT subject_entity AS uid, max(seq) AS born, arg_max(entity_type, seq) AS kind FROM rows WHERE event_type = 'entity.created' GROUP BY 1),
life AS (SELECT subject_entity AS uid, max(seq) AS died, arg_max(event_type, seq) AS last_event FROM rows WHERE event_type IN ('entity.deprecated', 'entity.archived') GROUP BY 1),
nm AS (SELECT subject_entity AS uid, arg_max(new_value, seq) AS display_name FROM rows WHERE event_type IN ('entity.created', 'entity.renamed') GROUP BY 1),
ct AS (SELECT subject_entity AS uid, count(*) AS n FROM rows WHERE event_type IN ('entity.created', 'entity.renamed', 'name.added') GROUP BY 1)
SELECT uid, CASE WHEN kind IN ('session', 'module') THEN kind ELSE 'repo' END AS entity_type, CASE WHEN died > born THEN substr(last_event, 8) ELSE 'active' END AS lifecycle_status, display_name, n AS name_count
FROM born LEFT JOIN life USING (uid) LEFT JOIN nm USING (uid) LEFT JOIN ct USING (uid)""")
@_t("event_log")
def _(ev):
    edge = ev.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).cast("string")).first()[0]
    return state.recover(ev, edge, cap=0)


_RECOVERED = """b AS (SELECT subject_entity AS uid, max(seq) AS born, arg_max(entity_type, seq) AS kind FROM event_log WHERE event_type = 'entity.created' GROUP BY 1),
lf AS (SELECT subject_entity AS uid, max(seq) AS died, arg_max(event_type, seq) AS last_event FROM event_log WHERE event_type IN ('entity.deprecated', 'entity.archived') GROUP BY 1),
r AS (SELECT uid, CASE WHEN kind IN ('session', 'module') THEN kind ELSE 'repo' END AS entity_type, CASE WHEN died > born THEN substr(last_event, 8) ELSE 'active' END AS lifecycle_status FROM b LEFT JOIN lf USING (uid)),
e AS (SELECT uid, entity_type, lifecycle_status FROM recovery_expected)"""


@query("t7_verify", f"WITH {_RECOVERED} SELECT uid, CASE WHEN r.entity_type IS NULL THEN 'missing' ELSE 'extra' END AS problem, NULL::VARCHAR AS recovered, NULL::VARCHAR AS expected FROM r FULL JOIN e USING (uid) WHERE r.entity_type IS NULL OR e.entity_type IS NULL UNION ALL SELECT uid, 'lifecycle_status', r.lifecycle_status, e.lifecycle_status FROM r JOIN e USING (uid) WHERE r.lifecycle_status <> e.lifecycle_status UNION ALL SELECT uid, 'entity_type', r.entity_type, e.entity_type FROM r JOIN e USING (uid) WHERE r.entity_type <> e.entity_type")
@_t("event_log", "recovery_expected")
def _(ev, e):
    return state.verify_recovery(state.recover(ev, cap=0), e)


_SNAP = " UNION ALL ".join(f"SELECT entity_id, '{f}' AS field, {a} AS old, {b} AS new FROM snapshot_before a FULL JOIN snapshot_after b USING (entity_id) WHERE a.{f} IS DISTINCT FROM b.{f}" for f, a, b in (("size", "a.size::VARCHAR", "b.size::VARCHAR"), ("kind", "a.kind", "b.kind")))


@query("t10_snapshot_diff", _SNAP)
@_t("snapshot_before", "snapshot_after")
def _(a, b):
    return state.snapshot_diff(a, b, ["size", "kind"])


@query("e4_registry_changes", "SELECT entity_id, 'file_created' AS signal_type, NULL::VARCHAR AS field, NULL::VARCHAR AS previous_value, NULL::VARCHAR AS value FROM snapshot_after WHERE entity_id NOT IN (SELECT entity_id FROM snapshot_before) UNION ALL SELECT entity_id, 'file_deleted', NULL, NULL, NULL FROM snapshot_before WHERE entity_id NOT IN (SELECT entity_id FROM snapshot_after) UNION ALL SELECT entity_id, 'registry_updated', 'size', a.size::VARCHAR, b.size::VARCHAR FROM snapshot_before a JOIN snapshot_after b USING (entity_id) WHERE a.size IS DISTINCT FROM b.size UNION ALL SELECT entity_id, 'registry_updated', 'kind', a.kind, b.kind FROM snapshot_before a JOIN snapshot_after b USING (entity_id) WHERE a.kind IS DISTINCT FROM b.kind")
@_t("snapshot_before", "snapshot_after")
def _(a, b):
    return state.registry_changes(a, b, ["size", "kind"])


def _sign(at: str) -> str:
    return f"""WITH RECURSIVE {PARENT(ACT(at))}, up AS (SELECT child_id AS uid, parent_id AS a, 1 AS d FROM parent UNION ALL SELECT uid, p.parent_id, d + 1 FROM up JOIN parent p ON p.child_id = a),
dp AS (SELECT uid, max(d) AS depth FROM up GROUP BY 1), k AS (SELECT parent_id AS uid, count(*) AS n FROM hierarchy_edges WHERE {ACT(at)} GROUP BY 1),
og AS (SELECT source_id AS uid, count(*) AS n FROM relation_edges WHERE {ACT(at)} GROUP BY 1), ic AS (SELECT target_id AS uid, count(*) AS n FROM relation_edges WHERE {ACT(at)} GROUP BY 1)
SELECT e.uid, p.parent_id, substr(sha256('{{"children": ' || coalesce(k.n, 0) || ', "depth": ' || coalesce(dp.depth, 0) || ', "incoming": ' || coalesce(ic.n, 0) || ', "outgoing": ' || coalesce(og.n, 0) || ', "parent": ' || coalesce('"' || p.parent_id || '"', 'null') || '}}'), 1, 16) AS fingerprint
FROM entities e LEFT JOIN parent p ON p.child_id = e.uid LEFT JOIN k ON k.uid = e.uid LEFT JOIN og ON og.uid = e.uid LEFT JOIN ic ON ic.uid = e.uid LEFT JOIN dp ON dp.uid = e.uid"""


@query("c5_fingerprint", f"SELECT * FROM ({_sign(NOW)})")
@_t("entities", "hierarchy_edges", "relation_edges")
def _(e, h, r):
    return state.signatures(e, h, r, NOW).select("uid", "parent_id", "fingerprint")


# Rules


def _route_sql() -> str:
    known = [r for r in RULES if set(r["match"]) <= set(rules.DIMENSIONS)]
    tests = lambda m: " AND ".join(f"{k} = '{v}'" for k, v in m.items())
    case = lambda what, other: "CASE " + " ".join(f"WHEN {tests(r['match'])} THEN {what(r)}" for r in known) + f" ELSE {other} END"
    return f"SELECT artifact_id, {case(lambda r: r['id'], 'NULL')} AS rule_id, {case(lambda r: chr(39) + r['target'] + chr(39), chr(39) + FALLBACK + chr(39))} AS target FROM artifacts"


@query("j9_routing", _route_sql())
@_t("artifacts")
def _(a):
    return rules.route(a, RULES, FALLBACK).select("artifact_id", "rule_id", "target")


@query("p2_policies", """WITH h AS (SELECT uid, 'p-module' AS policy_id, 'review' AS action, 9 AS priority, 1 AS i FROM entities WHERE entity_type = 'module' AND lifecycle_status IN ('deprecated', 'archived')
UNION ALL SELECT uid, 'p-inactive', 'flag', 5, 0 FROM entities WHERE lifecycle_status <> 'active' UNION ALL SELECT uid, 'p-always', 'log', 1, 2 FROM entities WHERE entity_type = 'organ'
UNION ALL SELECT uid, 'p-uid', 'note', 5, 4 FROM entities WHERE uid LIKE '%7%' AND lifecycle_status = 'archived')
SELECT uid, policy_id, action, priority, row_number() OVER (PARTITION BY uid ORDER BY priority DESC, i) AS place FROM h""")
@_t("entities")
def _(e):
    return rules.evaluate_policies(e, POLICIES)


_RANK = "CASE {} WHEN 'global' THEN 1 WHEN 'organ' THEN 2 WHEN 'repo' THEN 3 ELSE 4 END".format
_REQUESTS = """q AS (SELECT c_custkey AS request_id, 'key' || (c_custkey % 12)::VARCHAR AS key, CASE c_custkey % 3 WHEN 0 THEN 'organ' WHEN 1 THEN 'repo' ELSE 'module' END AS scope, 'region:' || (c_custkey % 5)::VARCHAR AS o, 'nation:' || c_nationkey::VARCHAR AS n, 'customer:' || c_custkey::VARCHAR AS m FROM customer)"""
_FOUND = f"""{_REQUESTS}, f AS (SELECT request_id, q.key, q.scope, v.scope AS found_scope, v.entity_id AS found_entity, v.value, row_number() OVER (PARTITION BY request_id ORDER BY {_RANK('v.scope')} DESC, v.seq) AS k
FROM q JOIN variables v ON v.key = q.key AND {_RANK('v.scope')} <= {_RANK('q.scope')} AND (v.entity_id IS NULL OR v.scope = 'global' OR v.entity_id = CASE v.scope WHEN 'organ' THEN o WHEN 'repo' THEN n ELSE m END))"""


def _requests(spark, sf_dir):
    c, key = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    scope = F.when(key % 3 == 0, "organ").when(key % 3 == 1, "repo").otherwise("module")
    chain = F.create_map(F.lit("organ"), F.concat(F.lit("region:"), (key % 5).cast("string")), F.lit("repo"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")), F.lit("module"), F.concat(F.lit("customer:"), key.cast("string")))
    return c.select(key.alias("request_id"), F.concat(F.lit("key"), (key % 12).cast("string")).alias("key"), scope.alias("scope"), chain.alias("chain"))


@query("v1_set_variables", "WITH g AS (SELECT key, scope, entity_id, min(seq) AS seq, coalesce(min(CASE WHEN mutability = 'constant' THEN seq END), max(seq)) AS pick FROM variables GROUP BY 1, 2, 3) SELECT g.seq, g.key, g.scope, g.entity_id, v.value, v.mutability FROM g JOIN variables v ON v.seq = g.pick")
@_t("variables")
def _(v):
    return rules.set_variables(v)


@query("v2_scope_lookup", f"WITH {_FOUND} SELECT request_id, key, scope, found_scope, found_entity, value FROM f WHERE k = 1")
def _(spark, sf_dir):
    return rules.find_in_chain(_requests(spark, sf_dir), derived(spark, sf_dir, "variables"))


@query("v3_overrides", f"SELECT key, scope, entity_id, value, row_number() OVER (ORDER BY {_RANK('scope')} DESC, seq) AS place FROM variables WHERE key = 'key4'")
@_t("variables")
def _(v):
    return rules.overrides(v, "key4")


@query("v4_resolve_variable", f"WITH {_FOUND} SELECT q.request_id, q.key, q.scope, CASE WHEN found_scope IS NULL THEN 'none' ELSE value END AS value, CASE WHEN found_scope IS NULL THEN 'default' WHEN found_scope = q.scope THEN 'direct' ELSE 'inherited' END AS source FROM q LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (request_id)")
def _(spark, sf_dir):
    return rules.resolve_variables(_requests(spark, sf_dir), derived(spark, sf_dir, "variables"), "none")


_STEPS = ("accumulating", "evaluating", "proposed", "approved", "applied", "rejected", "cancelled")
_ALLOWED = " ".join(f"WHEN '{k}' THEN x.status IN ({', '.join(repr(v) for v in vs)})" for k, vs in rules.STEPS.items() if vs)


@query("p6_revisions", f"""RECURSIVE x AS (SELECT subject_entity AS revision_id, row_number() OVER (PARTITION BY subject_entity ORDER BY seq) AS k, list_extract([{', '.join(repr(v) for v in _STEPS)}], CAST((seq * 5 + seq // 7) % 7 + 1 AS INTEGER)) AS status FROM event_log),
f AS (SELECT DISTINCT revision_id, CAST(0 AS BIGINT) AS k, 'detected' AS status, 0 AS accepted, 0 AS refused FROM x
UNION ALL SELECT f.revision_id, x.k, CASE WHEN CASE f.status {_ALLOWED} ELSE false END THEN x.status ELSE f.status END, f.accepted + CAST(CASE f.status {_ALLOWED} ELSE false END AS INTEGER), f.refused + CAST(NOT CASE f.status {_ALLOWED} ELSE false END AS INTEGER) FROM f JOIN x ON x.revision_id = f.revision_id AND x.k = f.k + 1)
SELECT revision_id, arg_max(status, k) AS status, CAST(max(accepted) AS INTEGER) AS accepted, CAST(max(refused) AS INTEGER) AS refused FROM f GROUP BY 1""")
@_t("event_log")
def _(ev):
    steps = F.element_at(F.array(*[F.lit(s) for s in _STEPS]), (F.expr("(seq * 5 + seq div 7) % 7") + 1).cast("int"))
    return rules.fold_revisions(ev.select(F.col("subject_entity").alias("revision_id"), "seq", steps.alias("status")))


# Extensions: rolling, delta, ratio and distribution metrics


@query("ext_rolling", "SELECT seq, round(avg(value) OVER (PARTITION BY metric_id, entity_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 4) AS rolling FROM observations")
@_t("observations")
def _(o):
    return metrics.rolling(o, 86400).select("seq", F.round("rolling", 4).alias("rolling"))


@query("ext_delta", "SELECT seq, round(value - lag(value) OVER (PARTITION BY metric_id, entity_id ORDER BY seq), 4) AS delta FROM observations")
@_t("observations")
def _(o):
    return metrics.delta(o).select("seq", F.round("delta", 4).alias("delta"))


@query("ext_ratio", "WITH l AS (SELECT entity_id, metric_id, arg_max(value, seq) AS v FROM observations WHERE metric_id IN ('purchase', 'view') GROUP BY 1, 2) SELECT entity_id, round(max(CASE WHEN metric_id = 'purchase' THEN v END) / nullif(max(CASE WHEN metric_id = 'view' THEN v END), 0), 4) AS ratio FROM l GROUP BY 1")
@_t("observations")
def _(o):
    return metrics.ratio(o, "purchase", "view").select("entity_id", F.round("ratio", 4).alias("ratio"))


@query("ext_distribution", "SELECT metric_id, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM observations GROUP BY 1")
@_t("observations")
def _(o):
    return metrics.distribution(o).select("metric_id", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


# Mutations


def _moves(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 13 = 0")
    return c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("child_id"), F.concat(F.lit("nation:"), ((F.col("c_nationkey") + 7) % 25).cast("string")).alias("parent_id"))


@query("m7_relocate", f"WITH mv AS (SELECT 'customer:' || c_custkey AS child_id, 'nation:' || ((c_nationkey + 7) % 25) AS new_parent FROM customer WHERE c_custkey % 13 = 0) SELECT parent_id, child_id, CASE WHEN {ACT(NOW)} AND child_id IN (SELECT child_id FROM mv) THEN '{NOW}' ELSE CAST(valid_to AS VARCHAR) END AS valid_to FROM hierarchy_edges UNION ALL SELECT new_parent, child_id, NULL FROM mv")
def _(spark, sf_dir):
    edges = mutate.relocate(derived(spark, sf_dir, "hierarchy_edges"), _moves(spark, sf_dir), NOW)
    return edges.select("parent_id", "child_id", F.col("valid_to").cast("string").alias("valid_to"))


_MERGE = f"""WITH src AS (SELECT 'nation:' || n_nationkey AS uid, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, 'merged:' || n_regionkey AS successor FROM nation),
a AS (SELECT * FROM hierarchy_edges WHERE {ACT(NOW)})
SELECT s.successor AS parent_id, a.child_id FROM a JOIN src s ON s.uid = a.parent_id UNION ALL SELECT a.parent_id, s.successor FROM a JOIN src s ON s.uid = a.child_id{{}}"""


def _merge(spark, sf_dir, form):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    groups = n.select(F.col("n_nationkey").cast("bigint").alias("seq"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("source_uid"), F.concat(F.lit("merged:"), F.col("n_regionkey").cast("string")).alias("successor"))
    return mutate.merge(derived(spark, sf_dir, "entities"), derived(spark, sf_dir, "hierarchy_edges"), groups, NOW, form)


def _split_store(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 17 = 0")
    specs = c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("source_uid"), F.explode(F.array(*[F.concat(F.col("c_custkey").cast("string"), F.lit(f"/{i}")) for i in "ab"])).alias("descendant"))
    return mutate.split(derived(spark, sf_dir, "entities"), derived(spark, sf_dir, "hierarchy_edges"), specs, NOW)


_PICKED = "(SELECT 'customer:' || c_custkey AS uid FROM customer WHERE c_custkey % 21 = 0)"


def _picked(spark, sf_dir, name="uid"):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 21 = 0")
    return c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias(name))


@query("m1_create_entity", "SELECT uid, entity_type, lifecycle_status FROM entities UNION ALL SELECT 'new:' || r_regionkey, 'organ', 'active' FROM region")
def _(spark, sf_dir):
    new = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("new:"), F.col("r_regionkey").cast("string")).alias("uid"), F.lit("organ").alias("entity_type"))
    return mutate.create(derived(spark, sf_dir, "entities"), new).select("uid", "entity_type", "lifecycle_status")


@query("m2_update_lifecycle", f"SELECT uid, CASE WHEN uid IN {_PICKED} THEN 'archived' ELSE lifecycle_status END AS lifecycle_status FROM entities")
def _(spark, sf_dir):
    return mutate.set_status(derived(spark, sf_dir, "entities"), _picked(spark, sf_dir), "archived").select("uid", "lifecycle_status")


@query("m3_rename", f"SELECT entity_id, display_name, CAST(CASE WHEN entity_id IN {_PICKED} AND is_primary AND {ACT(NOW)} THEN TIMESTAMP '{NOW}' ELSE valid_to END AS VARCHAR) AS valid_to, is_primary AND NOT (entity_id IN {_PICKED} AND {ACT(NOW)}) AS is_primary FROM names UNION ALL SELECT uid, 'New ' || uid, NULL, true FROM {_PICKED}")
def _(spark, sf_dir):
    changes = _picked(spark, sf_dir, "entity_id").withColumn("display_name", F.concat(F.lit("New "), F.col("entity_id")))
    return mutate.rename(derived(spark, sf_dir, "names"), changes, NOW).select("entity_id", "display_name", F.col("valid_to").cast("string").alias("valid_to"), "is_primary")


@query("m4_retire_name", f"SELECT seq, CAST(CASE WHEN entity_id IN {_PICKED} AND {ACT(NOW)} THEN TIMESTAMP '{NOW}' ELSE valid_to END AS VARCHAR) AS valid_to FROM names")
def _(spark, sf_dir):
    n = derived(spark, sf_dir, "names")
    gone = n.join(_picked(spark, sf_dir, "entity_id"), "entity_id", "left_semi")
    return mutate.retire_name(n, gone, NOW).select("seq", F.col("valid_to").cast("string").alias("valid_to"))


@query("m6_retire_edges", f"WITH f AS (SELECT child_id, parent_id, min(seq) AS seq FROM hierarchy_edges WHERE {ACT(NOW)} AND child_id IN {_PICKED} GROUP BY 1, 2) SELECT seq, CAST(CASE WHEN seq IN (SELECT seq FROM f) THEN TIMESTAMP '{NOW}' ELSE valid_to END AS VARCHAR) AS valid_to FROM hierarchy_edges")
def _(spark, sf_dir):
    h = derived(spark, sf_dir, "hierarchy_edges")
    gone = h.join(_picked(spark, sf_dir, "child_id"), "child_id", "left_semi")
    return mutate.retire_edges(h, gone, ["parent_id", "child_id"], NOW).select("seq", F.col("valid_to").cast("string").alias("valid_to"))


@query("m9_reclassify", f"SELECT uid, CASE WHEN uid IN {_PICKED} THEN 'repo' ELSE entity_type END AS entity_type FROM entities")
def _(spark, sf_dir):
    return mutate.reclassify(derived(spark, sf_dir, "entities"), _picked(spark, sf_dir).withColumn("entity_type", F.lit("repo"))).select("uid", "entity_type")


def _split_ctx(spark, sf_dir):
    specs = _picked(spark, sf_dir, "source_uid").withColumn("descendant", F.concat("source_uid", F.lit("/x")))
    return mutate.split(derived(spark, sf_dir, "entities"), derived(spark, sf_dir, "hierarchy_edges"), specs, NOW, "ctx")


def _changed(tables: dict[str, DataFrame]) -> DataFrame:
    """All that a merge or split leaves, in one table: part (entity, edge, lineage or result), a, b, c."""
    columns = {"entities": ("entity", "uid", "entity_type", "lifecycle_status"), "edges": ("edge", "parent_id", "child_id", "valid_to"), "lineage": ("lineage", "entity_id", "related_id", "lineage_type"), "result": ("result", tables["result"].columns[0], tables["result"].columns[1], "edges_created")}
    parts = [tables[k].select(F.lit(part).alias("part"), *[F.col(c).cast("string").alias(to) for c, to in zip(own, "abc")]) for k, (part, *own) in columns.items()]
    return reduce(DataFrame.unionByName, parts)


def _closed(hit: str) -> str:
    return f"SELECT 'edge' AS part, parent_id AS a, child_id AS b, CASE WHEN {ACT(NOW)} AND ({hit}) THEN '{NOW}' ELSE CAST(valid_to AS VARCHAR) END AS c FROM hierarchy_edges"


def _merged_sql(status: str, heirs: str, derived_from: str) -> str:
    opened = _MERGE.format(heirs)
    src, act = opened[: opened.index("\na AS")], opened[opened.index("\na AS") :]
    body = act[act.index("\nSELECT") :]
    return f"""{src} a AS (SELECT * FROM hierarchy_edges WHERE {ACT(NOW)}), o AS ({body})
SELECT 'entity' AS part, uid AS a, entity_type AS b, CASE WHEN uid IN (SELECT uid FROM src) THEN '{status}' ELSE lifecycle_status END AS c FROM entities
UNION ALL SELECT DISTINCT 'entity', successor, 'repo', 'active' FROM src
UNION ALL {_closed("parent_id IN (SELECT uid FROM src) OR child_id IN (SELECT s.uid FROM src s" + heirs + ")")}
UNION ALL SELECT 'edge', parent_id, child_id, NULL FROM o
UNION ALL SELECT 'lineage', uid, successor, 'merged_into' FROM src {derived_from}
UNION ALL SELECT 'result', successor, CAST(count(*) AS VARCHAR), CAST((SELECT count(*) FROM o WHERE parent_id = successor OR child_id = successor) AS VARCHAR) FROM src GROUP BY successor"""


def _split_sql(status: str, mod: int, ends: str, descendant: str, closes: bool) -> str:
    opened = f"UNION ALL SELECT 'edge', h.parent_id, d.descendant, NULL FROM d JOIN hierarchy_edges h ON h.child_id = d.uid WHERE {ACT(NOW)}" if closes else ""
    return f"""WITH d AS (SELECT uid, {descendant} AS descendant FROM (SELECT 'customer:' || c_custkey AS uid, c_custkey, unnest({ends}) AS i FROM customer WHERE c_custkey % {mod} = 0))
SELECT 'entity' AS part, uid AS a, entity_type AS b, CASE WHEN uid IN (SELECT uid FROM d) THEN '{status}' ELSE lifecycle_status END AS c FROM entities
UNION ALL SELECT 'entity', descendant, 'module', 'active' FROM d
UNION ALL {_closed("child_id IN (SELECT uid FROM d)" if closes else "false")} {opened}
UNION ALL SELECT 'lineage', descendant, uid, 'split_from' FROM d
UNION ALL SELECT 'result', uid, CAST(count(*) AS VARCHAR), CAST({f"count(*) * (SELECT count(*) FROM hierarchy_edges WHERE child_id = d.uid AND {ACT(NOW)})" if closes else "0"} AS VARCHAR) FROM d GROUP BY uid"""


@query("m10_merge_store", _merged_sql("deprecated", "", ""))
def _(spark, sf_dir):
    return _changed(_merge(spark, sf_dir, "store"))


@query("m11_merge_ctx", _merged_sql("merged", " WHERE s.k = 1", "UNION ALL SELECT 'lineage', successor, uid, 'derived_from' FROM src"))
def _(spark, sf_dir):
    return _changed(_merge(spark, sf_dir, "ctx"))


@query("m10_parent_after_merge", f"""WITH src AS (SELECT 'nation:' || n_nationkey AS uid, n_nationkey AS k, 'merged:' || n_regionkey AS successor FROM nation),
o AS (SELECT s.successor AS child_id, h.parent_id, row_number() OVER (PARTITION BY s.successor ORDER BY s.k, h.seq) AS k FROM hierarchy_edges h JOIN src s ON s.uid = h.child_id WHERE {ACT(NOW)})
SELECT child_id, arg_max(parent_id, k) AS parent_id, count(*) AS parents FROM o GROUP BY 1""")
def _(spark, sf_dir):
    after = _merge(spark, sf_dir, "store")["edges"].where("child_id like 'merged:%'")
    return temporal.parent_of(after, NOW).join(after.groupBy("child_id").agg(F.count("*").alias("parents")), "child_id")


@query("m12_split_store", _split_sql("deprecated", 17, "['a', 'b']", "c_custkey || '/' || i", True))
def _(spark, sf_dir):
    return _changed(_split_store(spark, sf_dir))


@query("m13_split_ctx", _split_sql("split", 21, "['x']", "uid || '/' || i", False))
def _(spark, sf_dir):
    return _changed(_split_ctx(spark, sf_dir))


def _placed(sql_key: str) -> str:
    return f"SELECT key, entity_id, row_number() OVER (PARTITION BY key ORDER BY seq, entity_id) AS place FROM (SELECT {sql_key} AS key, entity_id, min(seq) AS seq FROM names GROUP BY 1, 2)"


@query("r1_resolve_slug", _placed(SLUG))
@_t("names")
def _(n):
    return resolve.ids_in_order(n, "slug")


@query("r2_resolve_display_name", _placed("lower(display_name)"))
@_t("names")
def _(n):
    return resolve.ids_in_order(n, "lowered")


@query("x8_ids_by_name", "SELECT lower(display_name) AS key, entity_id, min(seq) AS seq FROM names GROUP BY 1, 2")
@_t("names")
def _(n):
    return resolve.by_key(n, "lowered")


@query("e5_filesystem_changes", "SELECT entity_id, 'file_created' AS signal_type FROM (SELECT entity_id FROM snapshot_after EXCEPT SELECT entity_id FROM snapshot_before) UNION ALL SELECT entity_id, 'file_deleted' FROM (SELECT entity_id FROM snapshot_before EXCEPT SELECT entity_id FROM snapshot_after)")
@_t("snapshot_before", "snapshot_after")
def _(a, b):
    return sensing.filesystem_signals(a, b).select("entity_id", "signal_type")


@query("e6_ci_flips", "SELECT entity_id, coalesce(a.size > 25, false)::VARCHAR AS previous_value, coalesce(b.size > 25, false)::VARCHAR AS value FROM snapshot_before a FULL JOIN snapshot_after b USING (entity_id) WHERE coalesce(a.size > 25, false) <> coalesce(b.size > 25, false)")
@_t("snapshot_before", "snapshot_after")
def _(a, b):
    of = lambda df: df.select("entity_id", (F.col("size") > 25).alias("has_ci"))
    return sensing.ci_signals(of(a), of(b)).select("entity_id", "previous_value", "value")


_REL = "SELECT DISTINCT source_id AS entity_id, target_id, relation_type FROM relation_edges WHERE {}".format


@query("t12_relation_changes", f"SELECT *, 'edge_added' AS signal_type FROM ({_REL(ACT(MIDDLE))} EXCEPT {_REL(ACT(EARLY))}) UNION ALL SELECT *, 'edge_removed' FROM ({_REL(ACT(EARLY))} EXCEPT {_REL(ACT(MIDDLE))})")
@_t("relation_edges")
def _(r):
    of = lambda at: temporal.as_of(r, at).withColumnRenamed("source_id", "entity_id")
    return sensing.relation_changes(of(EARLY), of(MIDDLE))


@query("t6_status_history", "WITH x AS (SELECT *, max(CASE WHEN event_type = 'entity.created' THEN seq END) OVER w AS born, last_value(CASE event_type WHEN 'entity.created' THEN 'active' WHEN 'entity.deprecated' THEN 'deprecated' WHEN 'entity.archived' THEN 'archived' END IGNORE NULLS) OVER w AS status FROM event_log WINDOW w AS (PARTITION BY subject_entity ORDER BY seq)), y AS (SELECT seq, subject_entity AS uid, last_value(CASE event_type WHEN 'entity.created' THEN 'active' WHEN 'entity.deprecated' THEN 'deprecated' WHEN 'entity.archived' THEN 'archived' END IGNORE NULLS) OVER (PARTITION BY subject_entity ORDER BY seq) AS status FROM x WHERE born IS NOT NULL) SELECT seq, uid, status FROM y")
@_t("event_log")
def _(ev):
    return state.last_status_window(ev)


# Stores: written, appended to and read back


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


@query("s8_latest_after_appends", "SELECT metric_id, entity_id, arg_max(value, (CASE seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) * 10000000000 + seq) AS value FROM observations GROUP BY 1, 2")
@_t("observations")
def _(o):
    """The last value by metric and entity of a log that three appends of different sizes made."""
    log, rows = Store(o.sparkSession, _place(o.sparkSession)), o.withColumnRenamed("ts", "timestamp")
    for part in ("seq % 5 = 0", "seq % 5 > 1", "seq % 5 = 1"):
        log.append("observations", rows.where(part))
    return metrics.latest(log.observations())


@query("s10_replay_after_appends", "SELECT subject_entity, new_value FROM event_log ORDER BY seq % 2 DESC, seq DESC LIMIT 300")
@_t("event_log")
def _(ev):
    log, rows = Store(ev.sparkSession, _place(ev.sparkSession)), ev.withColumnRenamed("ts", "timestamp")
    for part in ("seq % 2 = 0", "seq % 2 = 1"):
        log.append("events", rows.where(part))
    return metrics.replay(log.events(), limit=300).select("subject_entity", "new_value")


def _registry(spark, sf_dir) -> Registry:
    return Registry(*[derived(spark, sf_dir, n) for n in ("entities", "names", "hierarchy_edges", "relation_edges", "lineage", "observations", "event_log", "variables")], NOW)


@query("s21_open_store", _STATE)
def _(spark, sf_dir):
    """Entity states from a registry that was saved as a store and opened again."""
    path = _place(spark)
    _registry(spark, sf_dir).save(path)
    return open_store(spark, path, NOW).state_at(MIDDLE)


@query("s19_saved_names", "SELECT entity_id, display_name, coalesce(slug, " + SLUGGED + ") AS slug, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS place FROM names")
@_t("names")
def _(n):
    saved = Store(n.sparkSession, _place(n.sparkSession))
    saved.save_names(n.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")}))
    back = saved.names()
    return back.join(temporal.name_history(back).select("entity_id", "place", F.col("display_name").alias("__name")), "entity_id").where("display_name = __name").select("entity_id", "display_name", "slug", "place")


# The version log, names, snapshots, drift, inferences


def _versions(ev: DataFrame) -> DataFrame:
    return ev.select("seq", F.concat(F.lit("sv_"), F.col("seq").cast("string")).alias("version_id"), F.col("event_type").alias("change_type"), F.array("subject_entity").alias("affected_entities"))


@query("f7_versions_by_entity", "SELECT seq FROM event_log WHERE subject_entity = 'session:7'")
@_t("event_log")
def _(ev):
    return store.versions_by_entity(_versions(ev), "session:7").select("seq")


@query("f8_versions_by_type", "SELECT seq, 'sv_' || CAST(seq AS VARCHAR) AS version_id FROM event_log WHERE event_type = 'entity.archived'")
@_t("event_log")
def _(ev):
    return store.versions_by_type(_versions(ev), "entity.archived").select("seq", "version_id")


@query("f8_recent_versions", "SELECT seq FROM event_log ORDER BY seq DESC LIMIT 20")
@_t("event_log")
def _(ev):
    return store.recent_versions(_versions(ev)).select("seq")


@query("r6_name_history", "SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS place, display_name, is_primary FROM names")
@_t("names")
def _(n):
    return temporal.name_history(n).select("entity_id", "place", "display_name", "is_primary")


_SNAPS = f"""WITH s AS ({_sign(NOW)}), m AS (SELECT entity_id, count(*) AS n, sum(v) AS total FROM (SELECT entity_id, metric_id, arg_max(value, seq) AS v FROM observations GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT entity_id, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys FROM variables WHERE entity_id IS NOT NULL GROUP BY 1)
SELECT e.uid AS entity_id, e.lifecycle_status AS status, coalesce(m.n, 0) AS metrics, round(coalesce(m.total, 0), 4) AS total, s.fingerprint, coalesce(b.keys, '') AS keys FROM entities e JOIN s ON s.uid = e.uid LEFT JOIN m ON m.entity_id = e.uid LEFT JOIN b ON b.entity_id = e.uid"""


@query("t9_create_snapshot", _SNAPS)
def _(spark, sf_dir):
    r = _registry(spark, sf_dir)
    made = state.create_snapshots(r.entities, r.observations, state.signatures(r.entities, r.hierarchy, r.relations, NOW), r.variables, NOW)
    total = F.aggregate(F.map_values("metric_values"), F.lit(0.0), lambda a, x: a + x)
    return made.select("entity_id", F.col("properties")["lifecycle_status"].alias("status"), F.size("metric_values").cast("long").alias("metrics"), F.round(total, 4).alias("total"), F.col("structural_fingerprint").alias("fingerprint"), F.array_join(F.map_keys("variable_bindings"), ",").alias("keys"))


@query("c14_signatures_differ", f"SELECT a.uid, a.fingerprint <> b.fingerprint AS differ FROM ({_sign(EARLY)}) a JOIN ({_sign(NOW)}) b USING (uid)")
@_t("entities", "hierarchy_edges", "relation_edges")
def _(e, h, r):
    return state.signatures_differ(*state.signatures_at(e, h, r, [EARLY, NOW]))


@query("c14_drift", "SELECT entity_id, false AS fingerprint_changed, a.size IS DISTINCT FROM b.size OR a.kind IS DISTINCT FROM b.kind OR a.price IS DISTINCT FROM b.price AS drift FROM snapshot_before a JOIN snapshot_after b USING (entity_id)")
@_t("snapshot_before", "snapshot_after")
def _(a, b):
    none = F.create_map().cast("map<string,string>")
    snap = lambda df: df.select("entity_id", F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("kind"), F.col("kind")).alias("properties"), F.create_map(F.lit("price"), F.col("price").cast("double")).alias("metric_values"), F.lit("x").alias("structural_fingerprint"), none.alias("variable_bindings"))
    return state.drifted(snap(a), snap(b))


@query("g14_inferences", f"{_CLUSTERS.replace('SELECT s.component, s.n AS size, round', 'SELECT s.component, ' + chr(39) + 'cluster' + chr(39) + ' AS inference_type, ' + chr(39) + 'Cluster of ' + chr(39) + ' || s.n || ' + chr(39) + ' entities' + chr(39) + ' AS description, round').replace('AS cohesion FROM', 'AS score FROM')}")
@_t("depends_edges")
def _(r):
    found = graph.cluster_inferences(graph.clusters(r, NOW))
    return found.select("component", "inference_type", F.split("description", " with ")[0].alias("description"), F.round("score", 6).alias("score"))


_ORDER = f"""RECURSIVE act AS (SELECT parent_id, child_id, seq FROM hierarchy_edges WHERE {ACT(NOW)}),
walk AS (SELECT child_id AS node, 1 AS depth, [seq] AS o FROM act WHERE parent_id = 'region:2' UNION ALL SELECT a.child_id, w.depth + 1, list_append(w.o, a.seq) FROM walk w JOIN act a ON a.parent_id = w.node)
SELECT node, depth, row_number() OVER (ORDER BY depth, o) AS place FROM walk"""


@query("o5_breadth_first_order", _ORDER)
@_t("hierarchy_edges")
def _(h):
    found = graph.macro_descent(h, _one(h, "root", "region:2"), NOW)
    return numbered(found.select("node", "depth", "order"), ["depth", "order"], "place").select("node", "depth", "place")


# Variables


_BAD = "key = 'key1' AND NOT regexp_matches(value, '^(?:[a-m])')"


def _constrained(v: DataFrame) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    c = F.struct(none("array<string>").alias("allowed_values"), F.lit(1.0).alias("min_value"), none("double").alias("max_value"), F.lit("[a-m]").alias("pattern"), F.lit(True).alias("required"))
    return v.withColumn("constraint", F.when(F.col("key") == "key1", c))


_SET = "s AS (SELECT g.seq, g.key, g.scope, g.entity_id, v.value, v.mutability FROM (SELECT key, scope, entity_id, min(seq) AS seq, coalesce(min(CASE WHEN mutability = 'constant' THEN seq END), max(seq)) AS pick FROM variables{} GROUP BY 1, 2, 3) g JOIN variables v ON v.seq = g.pick)".format


@query("v1_set_constrained", f"WITH {_SET(f' WHERE NOT ({_BAD})')} SELECT * FROM s")
@_t("variables")
def _(v):
    return rules.set_variables(_constrained(v))


@query("v1_refused_sets", f"WITH f AS (SELECT key, scope, coalesce(entity_id, '') AS e, min(seq) AS first FROM variables WHERE NOT ({_BAD}) AND mutability = 'constant' GROUP BY 1, 2, 3) SELECT v.seq, CASE WHEN v.{_BAD.replace('value', 'v.value')} THEN 'pattern' ELSE 'constant' END AS reason FROM variables v LEFT JOIN f ON f.key = v.key AND f.scope = v.scope AND f.e = coalesce(v.entity_id, '') WHERE v.{_BAD.replace('value', 'v.value')} OR v.seq > first")
@_t("variables")
def _(v):
    return rules.refused_sets(_constrained(v))


@query("v6_list_keys", "SELECT DISTINCT key FROM variables")
@_t("variables")
def _(v):
    return rules.list_keys(rules.set_variables(v))


@query("f10_list_at_scope", f"WITH {_SET('')} SELECT seq, key, value FROM s WHERE scope = 'repo' AND entity_id = 'nation:22'")
@_t("variables")
def _(v):
    return rules.list_at_scope(rules.set_variables(v), "repo", "nation:22").select("seq", "key", "value")


@query("f11_get_variable", f"WITH {_SET('')} SELECT seq, key, scope, entity_id, value FROM s WHERE scope = 'global' OR scope = 'organ' AND entity_id = 'region:1'")
@_t("variables")
def _(v):
    wanted = v.select("key").distinct().select("key", F.explode(F.array(F.struct(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("entity_id")), F.struct(F.lit("organ").alias("scope"), F.lit("region:1").alias("entity_id")))).alias("x")).select("key", "x.*")
    return rules.get_variables(rules.set_variables(v), wanted).select("seq", "key", "scope", "entity_id", "value")


@query("v6_delete", f"WITH {_SET('')} SELECT seq, key, scope, entity_id FROM s WHERE NOT (scope IN ('global', 'organ') AND mutability <> 'constant')")
@_t("variables")
def _(v):
    kept = rules.set_variables(v)
    return rules.delete_variables(kept, kept.where("scope in ('global', 'organ')")).select("seq", "key", "scope", "entity_id")


@query("c16_scope_chain", "SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN 'organ>global' WHEN 1 THEN 'repo>organ>global' ELSE 'module>repo>organ>global' END AS chain FROM customer", raw=True)
def _(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", F.array_join(rules.scope_chain(F.col("scope")), ">").alias("chain"))


_KIND = "CASE WHEN found_scope = 'global' THEN CASE q.key {} END END".format


@query("v4_environment_and_reference", f"""WITH {_FOUND} SELECT q.request_id, q.key, q.scope, CASE WHEN found_scope IS NULL THEN 'none' ELSE coalesce({_KIND("WHEN 'key2' THEN 'set' WHEN 'key4' THEN 'none' WHEN 'key6' THEN 'set' WHEN 'key8' THEN 'set'")}, value) END AS value,
CASE WHEN found_scope IS NULL THEN 'default' ELSE coalesce({_KIND("WHEN 'key2' THEN 'environment' WHEN 'key4' THEN 'environment' WHEN 'key6' THEN 'reference' WHEN 'key8' THEN 'reference'")}, CASE WHEN found_scope = q.scope THEN 'direct' ELSE 'inherited' END) END AS source FROM q LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (request_id)""")
def _(spark, sf_dir):
    """Of the global variables, key2 and key4 name entries of the environment (one is missing), key6 refers to key2 and key8 to key6."""
    special = lambda kinds, other: reduce(lambda c, kv: c.when((F.col("scope") == "global") & (F.col("key") == kv[0]), F.lit(kv[1])), kinds.items(), F.when(F.lit(False), F.lit(""))).otherwise(other)
    v = derived(spark, sf_dir, "variables")
    v = v.withColumns({"value": special({"key2": "PLACE", "key4": "", "key6": "key2", "key8": "key6"}, F.col("value")), "mutability": special({"key2": "environment", "key4": "environment", "key6": "reference", "key8": "reference"}, F.col("mutability"))})
    return rules.resolve_variables(_requests(spark, sf_dir), v, "none", {"PLACE": "set"})


@query("p6_evidence", "SELECT subject_entity AS revision_id, count(*) AS evidence_count, arg_max(event_type, seq) AS last_type, arg_max(new_value, seq) AS last_description FROM event_log GROUP BY 1")
@_t("event_log")
def _(ev):
    log = ev.select(F.col("subject_entity").alias("revision_id"), "seq", F.col("event_type").alias("evidence_type"), F.col("new_value").alias("description"), "ts")
    return rules.evidence_of(log).drop("updated_at")


from . import extended  # noqa: E402, F401  (registers more queries by the decorator above)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

