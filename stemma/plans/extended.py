"""More queries: as-of joins, trees at once, rules as tables, and what else joins tables where ``catalog`` compiles or loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import asof, forest, graph, metrics, mutate, policytable, reach, rules, state, temporal
from ..registry import open_store
from ..sources import sealed
from ..streaming import recovery
from .catalog import _CLUSTERS, ACT, FALLBACK, _moves, _place, _registry, _t, query
from .derived import NOW, derived

# States at a time per row

_HELD = "valid_from <= r.asked_at AND (valid_to IS NULL OR valid_to > r.asked_at)"
_NAMED_AT = f"named_at AS (SELECT r.request_id, arg_max(n.display_name, (CASE WHEN n.is_primary THEN 1000000000000 ELSE 0 END) + n.seq) AS primary_name FROM state_requests AS r JOIN names AS n ON n.entity_id = r.entity_id AND {_HELD} GROUP BY 1)"
_PARENT_AT = f"parent_at AS (SELECT r.request_id, arg_max(h.parent_id, h.seq) AS parent_id FROM state_requests AS r JOIN hierarchy_edges AS h ON h.child_id = r.entity_id AND {_HELD} GROUP BY 1)"


def _counted(name: str, table: str, key: str) -> str:
    return f"{name} AS (SELECT r.request_id, count(*) AS {name} FROM state_requests AS r JOIN {table} AS e ON e.{key} = r.entity_id AND {_HELD} GROUP BY 1)"


_COUNTS = [("child_count", "hierarchy_edges", "parent_id"), ("outgoing_count", "relation_edges", "source_id"), ("incoming_count", "relation_edges", "target_id")]


@query("j14_state_at_each_date", f"""WITH {_NAMED_AT}, {_PARENT_AT}, {", ".join(_counted(*c) for c in _COUNTS)}
SELECT r.request_id, r.entity_id, entity_type, lifecycle_status, primary_name, parent_id, {", ".join(f"coalesce({c[0]}, 0) AS {c[0]}" for c in _COUNTS)}
FROM state_requests AS r LEFT JOIN entities ON uid = r.entity_id LEFT JOIN named_at USING (request_id) LEFT JOIN parent_at USING (request_id) {" ".join(f"LEFT JOIN {c[0]} USING (request_id)" for c in _COUNTS)}""")
@_t("state_requests", "entities", "names", "hierarchy_edges", "relation_edges")
def _(r, e, n, h, rel):
    """Each customer's state at the date of each order, each supplier's at the date of each shipment."""
    return asof.states_at(r.withColumnRenamed("asked_at", "at"), e, n, h, rel).drop("at")


@query("t2_names_at_each_date", f"WITH {_NAMED_AT} SELECT * FROM named_at")
@_t("state_requests", "names")
def _(r, n):
    return asof.names_at(r.withColumnRenamed("asked_at", "at"), n).select("request_id", F.col("display_name").alias("primary_name"))


@query("t2_parents_at_each_date", f"WITH {_PARENT_AT} SELECT * FROM parent_at")
@_t("state_requests", "hierarchy_edges")
def _(r, h):
    return asof.parents_at(r.withColumnRenamed("asked_at", "at"), h)


# Trees at once

_ACTIVE = f"act AS (SELECT * FROM hierarchy_edges WHERE {ACT(NOW)})"
_POLICIES = {"sum": "sum(s)", "avg": "avg(a)", "max": "max(x)", "min": "min(m)", "count": "count(*)::DOUBLE", "latest": "arg_max(l, seq)"}


def _level(name: str, below: str, where: str) -> str:
    """The parents of one level, from the rolled values (s, a, x, m, l) of the level below."""
    values = ", ".join(f"coalesce(b.{v}, 0) AS {v}" for v in "saxml")
    over = "sum(s) AS s, avg(a) AS a, max(x) AS x, min(m) AS m, arg_max(l, seq) AS l"
    return f"{name} AS (SELECT parent_id AS uid, count(*) AS n, {over} FROM (SELECT h.parent_id, h.seq, {values} FROM act AS h LEFT JOIN {below} AS b ON b.uid = h.child_id WHERE h.parent_id LIKE '{where}') GROUP BY 1)"


@query("a3_rollup_forest", f"""WITH {_ACTIVE}, leaf AS (SELECT entity_id AS uid, v AS s, v AS a, v AS x, v AS m, v AS l FROM (SELECT entity_id, arg_max(value, seq) AS v FROM observations WHERE metric_id = 'total' GROUP BY 1)),
{_level("cust", "leaf", "customer:%")}, {_level("nat", "cust", "nation:%")}, {_level("reg", "nat", "region:%")}
SELECT uid AS entity_id, n AS child_count, round(s, 4) AS sum, round(a, 6) AS avg, round(x, 4) AS max, round(m, 4) AS min, n::DOUBLE AS count, round(l, 4) AS latest FROM (SELECT * FROM cust UNION ALL SELECT * FROM nat UNION ALL SELECT * FROM reg)""")
@_t("hierarchy_edges", "observations")
def _(h, o):
    """For every node with children at once, all policies."""
    out = forest.rollup_forest(h, o, "total", NOW)
    return out.select("entity_id", "child_count", *[F.round(p, 6 if p == "avg" else 4).alias(p) for p in _POLICIES])


_BELOW = f"{_ACTIVE}, below AS (SELECT parent_id AS root, child_id AS node FROM act UNION SELECT root, child_id FROM below JOIN act ON parent_id = node)"


@query("a4_forest_sizes", f"RECURSIVE {_BELOW} SELECT root AS node, count(*) AS size FROM below GROUP BY 1")
@_t("hierarchy_edges")
def _(h):
    return forest.subtree_sizes(h, NOW).where("size > 0")


@query("g11_tree_numbers", f"""RECURSIVE {_BELOW}, nodes AS (SELECT child_id AS node, parent_id AS parent, seq FROM act UNION ALL SELECT DISTINCT parent_id, NULL, NULL FROM act WHERE parent_id NOT IN (SELECT child_id FROM act)),
sized AS (SELECT n.node, n.parent, n.seq, 1 + coalesce(b.size, 0) AS size FROM nodes AS n LEFT JOIN (SELECT root, count(*) AS size FROM below GROUP BY 1) AS b ON b.root = n.node),
offs AS (SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY parent ORDER BY seq, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sized),
up AS (SELECT node AS root, node FROM nodes UNION ALL SELECT root, node FROM below)
SELECT u.node, count(*) - 1 AS depth, any_value(o2.size)::BIGINT AS size, sum(o.off)::BIGINT AS pre, (sum(o.off) - count(*) + any_value(o2.size))::BIGINT AS post FROM up AS u JOIN offs AS o ON o.node = u.root JOIN offs AS o2 ON o2.node = u.node GROUP BY 1""")
@_t("hierarchy_edges")
def _(h):
    return forest.tour(forest.forest(h, NOW)).select("node", "depth", "size", "pre", "post")


# Rules and policies as tables

_DIMS = " AND ".join(f"(r.{d} IS NULL OR r.{d} = a.{d})" for d in rules.DIMENSIONS)


@query("j9_rule_table", f"""WITH m AS (SELECT a.artifact_id, arg_min(struct_pack(rule_id := r.rule_id, target := r.target), r.place) AS x FROM artifacts AS a JOIN rule_table AS r ON {_DIMS} GROUP BY 1)
SELECT artifact_id, x.rule_id AS rule_id, coalesce(x.target, '{FALLBACK}') AS target FROM artifacts LEFT JOIN m USING (artifact_id)""")
@_t("artifacts", "rule_table")
def _(a, r):
    return rules.route_by_table(a, r, FALLBACK).select("artifact_id", "rule_id", "target")


@query("p2_policy_table", """WITH f AS (SELECT 'customer:' || c_custkey::VARCHAR AS uid, c_acctbal AS b, c_mktsegment AS s, c_nationkey AS n FROM customer),
ok AS (SELECT f.uid, c.policy_id, count(*) AS held FROM policy_conditions AS c JOIN f ON CASE c.field || c.operator WHEN 'balancegt' THEN b > c.number WHEN 'balancelt' THEN b < c.number WHEN 'segmentin' THEN list_contains(string_split(c.text, ','), s) ELSE n <> c.number END GROUP BY 1, 2),
total AS (SELECT policy_id, count(*) AS asked FROM policy_conditions GROUP BY 1)
SELECT uid, policy_id, action, priority FROM ok JOIN total USING (policy_id) JOIN policy_table USING (policy_id) WHERE held = asked AND enabled AND (scope IS NULL OR scope = 'module')""")
def _(spark, sf_dir):
    """A policy a part, with bounds of balances, segments and nations, and all customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    uid, none = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.lit(None)
    fact = lambda field, n, t: c.select(uid.alias("uid"), F.lit(field).alias("field"), n.cast("double").alias("number"), t.cast("string").alias("text"))
    facts = fact("balance", F.col("c_acctbal"), none).union(fact("nation", F.col("c_nationkey"), none)).union(fact("segment", none, F.col("c_mktsegment")))
    conditions = derived(spark, sf_dir, "policy_conditions")
    listed = F.col("operator") == "in"
    conditions = conditions.withColumn("items", F.when(listed, F.split("text", ","))).withColumn("text", F.when(~listed, F.col("text")))
    entities = derived(spark, sf_dir, "entities").where("entity_type = 'module'").join(c.select(uid.alias("uid")), "uid", "left_semi")
    return policytable.match(entities, facts, derived(spark, sf_dir, "policy_table"), conditions)


# What a registry logs and keeps


def _merges(spark, sf_dir):
    """Nations into their regions' successors, in descending order of their keys, so that neither text nor number is the order."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    uid = F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))
    return n.select((100 - F.col("n_nationkey")).cast("bigint").alias("seq"), uid.alias("source_uid"), F.concat(F.lit("merged:"), F.col("n_regionkey").cast("string")).alias("successor"))


@query("m15_first_predecessor", "SELECT 'merged:' || n_regionkey::VARCHAR AS node, 'nation:' || max(n_nationkey)::VARCHAR AS ancestor FROM nation GROUP BY n_regionkey", raw=True)
def _(spark, sf_dir):
    """After merges, a successor's ancestry leads to its first source."""
    merged = _registry(spark, sf_dir).merge(_merges(spark, sf_dir), "ctx")
    return graph.trace_ancestry(merged.lineage, max_depth=1).where("node like 'merged:%'").select("node", "ancestor")


@query("m11_lineage_order", """WITH old AS (SELECT max(seq) AS top FROM lineage), new AS (
SELECT 'merged:' || n_regionkey::VARCHAR AS entity_id, 'nation:' || n_nationkey::VARCHAR AS related_id, 'derived_from' AS lineage_type, (100 - n_nationkey) * 2 AS turn FROM nation
UNION ALL SELECT 'nation:' || n_nationkey::VARCHAR, 'merged:' || n_regionkey::VARCHAR, 'merged_into', (100 - n_nationkey) * 2 + 1 FROM nation)
SELECT seq, entity_id, related_id, lineage_type FROM lineage UNION ALL SELECT top + row_number() OVER (ORDER BY turn), entity_id, related_id, lineage_type FROM new, old""")
def _(spark, sf_dir):
    return _registry(spark, sf_dir).merge(_merges(spark, sf_dir), "ctx").lineage.select("seq", "entity_id", "related_id", "lineage_type")


@query("v7_variable_events", """WITH done AS (SELECT 100000000 + c_custkey AS seq, 'level' AS key, 'customer:' || c_custkey::VARCHAR AS entity_id, c_mktsegment AS value FROM customer)
SELECT (SELECT max(seq) FROM event_log) + row_number() OVER (ORDER BY seq) AS seq, entity_id AS subject_entity, key AS changed_property, value AS new_value FROM done""")
def _(spark, sf_dir):
    """A set a customer, and as many of constants that are refused and so leave no event."""
    c, r = spark.read.parquet(f"{sf_dir}/customer.parquet"), _registry(spark, sf_dir)
    uid, none = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.lit(None).cast("string")
    sets = c.select((100_000_000 + F.col("c_custkey")).cast("bigint").alias("seq"), F.lit("level").alias("key"), F.lit("module").alias("scope"), uid.alias("entity_id"), F.col("c_mktsegment").alias("value"), F.lit("runtime").alias("mutability"))
    held = r.variables.where("mutability = 'constant'").select("key", "scope", "entity_id").distinct()
    again = held.select((F.lit(200_000_000) + F.monotonically_increasing_id() % 1_000_000).alias("seq"), "key", "scope", "entity_id", F.lit("late").alias("value"), F.lit("runtime").alias("mutability"))
    after = r.set_variables(sets.unionByName(again))
    return after.events.where("event_type = 'variable.set'").select("seq", "subject_entity", "changed_property", "new_value")


@query("t5_names_from_payloads", "SELECT 'customer:' || c_custkey::VARCHAR AS uid, 'module' AS entity_type, c_name AS display_name, 1 AS name_count FROM customer", raw=True)
def _(spark, sf_dir):
    """A log in the form that stores keep, a creation's name and type in its payload, recovered after it was opened, saved and opened again."""
    from ..sources.store import Store

    path, c = _place(spark), spark.read.parquet(f"{sf_dir}/customer.parquet")
    payload = F.struct(F.lit("module").alias("entity_type"), F.col("c_name").alias("display_name"), F.struct(F.lit(1).alias("deep")).alias("more"))
    log = c.select(F.col("c_custkey").cast("bigint").alias("seq"), F.lit("entity.created").alias("event_type"), F.lit("system").alias("source"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("subject_entity"), payload.alias("payload"), F.lit("2001-01-01T00:00:00").alias("timestamp"))
    Store(spark, path).append("events", log)
    again = _place(spark)
    open_store(spark, path, NOW).save(again)
    return state.recover(open_store(spark, again, NOW).events, cap=0).select("uid", "entity_type", "display_name", F.col("name_count").cast("int").alias("name_count"))


# Reachability from every node at once

_DEPENDS = f"dep AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM depends_edges WHERE {ACT(NOW)} AND source_id <> target_id)"
_FAR = "far AS (SELECT root, node, min(depth) AS depth FROM walk WHERE root <> node GROUP BY 1, 2)"


def _walk(forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"RECURSIVE {_DEPENDS}, walk AS (SELECT {a} AS root, {b} AS node, 1 AS depth FROM dep UNION SELECT root, {b}, depth + 1 FROM walk JOIN dep ON {a} = node WHERE depth < 60), {_FAR}"


def _all_parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("root"))


@query("g3_reach_counts", f"{_walk(True)} SELECT 'part:' || p_partkey::VARCHAR AS root, coalesce(reached, 0) AS reached, coalesce(farthest, 0) AS farthest FROM part LEFT JOIN (SELECT root, count(*) AS reached, max(depth) AS farthest FROM far GROUP BY 1) ON root = 'part:' || p_partkey::VARCHAR")
def _(spark, sf_dir):
    """Of every part, how many it depends on, and how far."""
    return reach.counts(*reach.dependencies(derived(spark, sf_dir, "depends_edges"), _all_parts(spark, sf_dir), NOW))


@query("g4_dependents_depths", f"{_walk(False)} SELECT root, node, depth FROM far")
def _(spark, sf_dir):
    """Of every part, the parts that depend on it, and how far."""
    return reach.pairs(*reach.dependencies(derived(spark, sf_dir, "depends_edges"), _all_parts(spark, sf_dir), NOW, reverse=True))


@query("t5_recover_stream", """WITH born AS (SELECT subject_entity AS uid, max(seq) AS born, arg_max(entity_type, seq) AS kind FROM event_log WHERE event_type = 'entity.created' GROUP BY 1),
life AS (SELECT subject_entity AS uid, max(seq) AS died, arg_max(event_type, seq) AS last_event FROM event_log WHERE event_type IN ('entity.deprecated', 'entity.archived') GROUP BY 1),
nm AS (SELECT subject_entity AS uid, arg_max(new_value, seq) AS display_name FROM event_log WHERE event_type IN ('entity.created', 'entity.renamed') GROUP BY 1),
ct AS (SELECT subject_entity AS uid, count(*) AS n FROM event_log WHERE event_type IN ('entity.created', 'entity.renamed', 'name.added') GROUP BY 1)
SELECT uid, CASE WHEN kind IN ('session', 'module') THEN kind ELSE 'repo' END AS entity_type, CASE WHEN died > born THEN substr(last_event, 8) ELSE 'active' END AS lifecycle_status, display_name, n AS name_count
FROM born LEFT JOIN life USING (uid) LEFT JOIN nm USING (uid) LEFT JOIN ct USING (uid)""")
def _(spark, sf_dir):
    """The log's first third as a snapshot, the rest as a stream of several batches."""
    path, ev = _place(spark), derived(spark, sf_dir, "event_log")
    snapshot = state.recovery_parts(ev.where("seq % 3 = 0"))
    ev.where("seq % 3 <> 0").select("seq", "event_type", "subject_entity", "entity_type", "new_value").repartition(4).write.parquet(f"{path}/log")
    stream = spark.readStream.schema("seq long, event_type string, subject_entity string, entity_type string, new_value string").option("maxFilesPerTrigger", 2).parquet(f"{path}/log")
    recovery.recover_stream(stream, f"{path}/out", f"{path}/check", snapshot).awaitTermination()
    return recovery.recovered_so_far(spark, f"{path}/out", snapshot)


# Sealed logs


def _sealed_observations(spark, sf_dir):
    """The observations in three appends, of which the first two are then one segment."""
    log, o = sealed.observation_log(spark, _place(spark)), derived(spark, sf_dir, "observations").select("seq", "metric_id", "entity_id", "value", "ts")
    for part in ("seq % 3 = 0", "seq % 3 = 1"):
        log.append(o.where(part))
    log.compact()
    log.append(o.where("seq % 3 = 2"))
    return log


@query("f4_sealed_range", "SELECT seq, entity_id, value FROM observations WHERE metric_id = 'total' AND ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts <= TIMESTAMP '1998-06-01 00:00:00' ORDER BY seq DESC LIMIT 1000")
def _(spark, sf_dir):
    since, until = "1996-01-01 00:00:00", "1998-06-01 00:00:00"
    return metrics.query(_sealed_observations(spark, sf_dir).read(since=since, until=until), "total", None, since, until, 1000).select("seq", "entity_id", "value")


@query("w2_sealed_latest", "SELECT metric_id, entity_id, arg_max(value, seq) AS value FROM observations GROUP BY 1, 2")
def _(spark, sf_dir):
    return metrics.latest(_sealed_observations(spark, sf_dir).read())


@query("f7_version_postings", """WITH v AS (SELECT event_id AS seq, 'sv_' || event_id::VARCHAR AS version_id, unnest(['session:' || user_id::VARCHAR, 'session:' || (user_id + 1)::VARCHAR]) AS entity_id FROM events)
SELECT DISTINCT entity_id, seq, version_id FROM v WHERE entity_id IN (SELECT 'session:' || user_id::VARCHAR FROM events WHERE event_type = 'signup')""", raw=True)
def _(spark, sf_dir):
    """The versions that touch each session that signed up, by postings that two appends kept up."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    uid = lambda c: F.concat(F.lit("session:"), c.cast("string"))
    versions = ev.select(F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("sv_"), F.col("event_id").cast("string")).alias("version_id"), F.array(uid(F.col("user_id")), uid(F.col("user_id") + 1)).alias("affected_entities"))
    log = sealed.version_postings(spark, _place(spark))
    sealed.post(log, versions.where("seq % 2 = 0"))
    sealed.post(log, versions.where("seq % 2 = 1"))
    return sealed.versions_of(log, ev.where("event_type = 'signup'").select(uid(F.col("user_id")).alias("entity_id")))


# Scalars, mutations and views that other queries don't show


def _base32_sql(value: str, length: int) -> str:
    return f"array_to_string(list_transform(range({length - 1}, -1, -1), lambda i: substr('{fn.CROCKFORD}', ((({value}) >> (5 * i)::INT) & 31)::INT + 1, 1)), '')"


_MILLIS = 1_000_000_000_000


def _ulid_sql(key: str) -> str:
    half = lambda a: f"('0x' || substr(sha256({key}), {a}, 10))::BIGINT"
    return " || ".join([_base32_sql(f"{_MILLIS}::BIGINT", 10), _base32_sql(half(1), 8), _base32_sql(half(11), 8)])


@query("c2_base32", f"SELECT seq, {_base32_sql('seq', 10)} AS code FROM event_log")
@_t("event_log")
def _(ev):
    return ev.select("seq", fn.base32(F.col("seq"), 10).alias("code"))


@query("c4_entity_uids", f"SELECT uid, 'ent_' || CASE entity_type WHEN 'module' THEN 'mod' WHEN 'document' THEN 'doc' WHEN 'session' THEN 'sess' ELSE entity_type END || '_' || {_ulid_sql('uid')} AS own FROM entities")
@_t("entities")
def _(e):
    return e.select("uid", fn.entity_uid(F.col("entity_type"), F.lit(_MILLIS), F.col("uid")).alias("own"))


@query("j1_children", f"SELECT parent_id, child_id, seq FROM hierarchy_edges WHERE {ACT(NOW)} AND parent_id IN (SELECT uid FROM entities WHERE entity_type = 'repo')")
@_t("hierarchy_edges", "entities")
def _(h, e):
    return temporal.children_of(h, NOW, e.where("entity_type = 'repo'").select(F.col("uid").alias("parent_id"))).select("parent_id", "child_id", "seq")


@query("w6_rotated_parents", "SELECT seq, child_id, CAST(lead(valid_from) OVER (PARTITION BY child_id ORDER BY seq) AS VARCHAR) AS valid_to FROM hierarchy_edges")
@_t("hierarchy_edges")
def _(h):
    return temporal.rotate_parent(h.drop("valid_to")).select("seq", "child_id", F.col("valid_to").cast("string").alias("valid_to"))


@query("m8_relocate_ctx", f"""WITH mv AS (SELECT 'customer:' || c_custkey AS child_id, 'nation:' || ((c_nationkey + 7) % 25) AS new_parent FROM customer WHERE c_custkey % 13 = 0),
last AS (SELECT child_id, arg_max(parent_id, seq) AS parent_id FROM hierarchy_edges WHERE {ACT(NOW)} AND child_id IN (SELECT child_id FROM mv) GROUP BY 1),
hit AS (SELECT min(seq) AS seq FROM hierarchy_edges JOIN last USING (child_id, parent_id) WHERE {ACT(NOW)} GROUP BY child_id)
SELECT parent_id, child_id, CASE WHEN seq IN (SELECT seq FROM hit) THEN '{NOW}' ELSE CAST(valid_to AS VARCHAR) END AS valid_to FROM hierarchy_edges UNION ALL SELECT new_parent, child_id, NULL FROM mv""")
def _(spark, sf_dir):
    edges = mutate.relocate(derived(spark, sf_dir, "hierarchy_edges"), _moves(spark, sf_dir), NOW, "ctx")
    return edges.select("parent_id", "child_id", F.col("valid_to").cast("string").alias("valid_to"))


def _pairs(spark, sf_dir):
    key = F.col("s_suppkey")
    uid = lambda k: F.concat(F.lit("supplier:"), k.cast("string"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.cast("long").alias("seq"), uid(key).alias("uid"), F.when(key % 2 == 0, uid(key + 1)).alias("successor"))


@query("m14_deprecate", """SELECT 'entity' AS part, uid AS a, CASE WHEN uid LIKE 'supplier:%' THEN 'deprecated' ELSE lifecycle_status END AS b, 0 AS turn FROM entities
UNION ALL SELECT 'lineage', 'supplier:' || (s_suppkey + 1)::VARCHAR, 'supplier:' || s_suppkey::VARCHAR, row_number() OVER (ORDER BY s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'event', 'supplier:' || s_suppkey::VARCHAR, 'entity.deprecated', row_number() OVER (ORDER BY s_suppkey) FROM supplier""")
def _(spark, sf_dir):
    """All suppliers, every other one with a successor: entities, lineage and events, the last two as numbered after what was there."""
    r = _registry(spark, sf_dir)
    after = r.deprecate(_pairs(spark, sf_dir))
    top = lambda df: df.agg(F.max("seq")).first()[0]
    last_line, last_event = top(r.lineage), top(r.events)
    entities = after.entities.select(F.lit("entity").alias("part"), F.col("uid").alias("a"), F.col("lifecycle_status").alias("b"), F.lit(0).cast("long").alias("turn"))
    lines = after.lineage.where(F.col("seq") > last_line).select(F.lit("lineage"), "entity_id", "related_id", F.col("seq") - last_line)
    return entities.union(lines).union(after.events.where(F.col("seq") > last_event).select(F.lit("event"), "subject_entity", "event_type", F.col("seq") - last_event))


@query("m4_add_alias", f"SELECT entity_id, display_name, is_primary, CAST(valid_from AS VARCHAR) AS valid_from FROM names UNION ALL SELECT 'supplier:' || s_suppkey::VARCHAR, 'Also ' || s_name, false, '{NOW}' FROM supplier")
def _(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    aliases = s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.concat(F.lit("Also "), F.col("s_name")).alias("display_name"))
    return _registry(spark, sf_dir).add_alias(aliases).names.select("entity_id", "display_name", "is_primary", F.col("valid_from").cast("string").alias("valid_from"))


@query("m17_observe", "SELECT metric_id, entity_id, arg_max(value, seq) AS value FROM (SELECT seq, metric_id, entity_id, value FROM observations UNION ALL SELECT 5000000000 + o_orderkey, 'total', 'order:' || o_orderkey::VARCHAR, o_totalprice * 2 FROM orders) GROUP BY 1, 2")
def _(spark, sf_dir):
    """The latest values after one more observation of every order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    more = o.select((F.lit(5_000_000_000) + F.col("o_orderkey")).alias("seq"), F.lit("total").alias("metric_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("entity_id"), (F.col("o_totalprice") * 2).alias("value"), F.col("o_orderdate").alias("ts"))
    return metrics.latest(_registry(spark, sf_dir).observe(more).observations)


@query("x4_map_diff", """WITH a AS (SELECT entity_id, kind, size::VARCHAR AS size FROM snapshot_before), b AS (SELECT entity_id, kind, size::VARCHAR AS size FROM snapshot_after)
SELECT entity_id, 'kind' AS field, a.kind AS old, b.kind AS new FROM a FULL JOIN b USING (entity_id) WHERE a.kind IS DISTINCT FROM b.kind UNION ALL SELECT entity_id, 'size', a.size, b.size FROM a FULL JOIN b USING (entity_id) WHERE a.size IS DISTINCT FROM b.size""")
@_t("snapshot_before", "snapshot_after")
def _(a, b):
    """Properties as maps, whose keys need not be the same on both sides."""
    held = lambda df: df.select("entity_id", F.map_filter(F.create_map(F.lit("kind"), F.col("kind"), F.lit("size"), F.col("size").cast("string")), lambda _, v: v.isNotNull()).alias("m"))
    return state.compare_maps(held(a), held(b), "m")


@query("o2_clusters_in_order", _CLUSTERS.replace("SELECT s.component, s.n AS size,", "SELECT s.component, row_number() OVER (ORDER BY p / (n * (n - 1) / 2) DESC, s.component) AS place, s.n AS size,"))
@_t("depends_edges")
def _(r):
    """Clusters, the most cohesive first."""
    return graph.ordered_clusters(graph.clusters(r, NOW)).select("component", "size", F.round("cohesion", 6).alias("cohesion"), "place")
