"""Runtime counts, replay of the event log, snapshots and their differences, signatures, tensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, ulid
from ..session import checkpointed
from .graph import depths
from .metrics import latest
from .resolve import slug_of
from .temporal import as_of, at_literal, is_active

TYPES = ("organ", "repo", "module", "document", "session", "variable", "metric")
LIFECYCLE = {"entity.deprecated": "deprecated", "entity.archived": "archived", "entity.merged": "merged", "entity.split": "split"}
REPLAY_CAP = 100_000


def runtime_counts(entities: DataFrame) -> DataFrame:
    """dimension, value, n: entities by type and by status, in one aggregate with grouping sets."""
    rows = entities.groupingSets([[F.col("entity_type")], [F.col("lifecycle_status")]], F.col("entity_type"), F.col("lifecycle_status")).agg(F.count("*").alias("n"), F.grouping("entity_type").alias("g"))
    return rows.select(F.when(F.col("g") == 0, "entity_type").otherwise("lifecycle_status").alias("dimension"), F.coalesce("entity_type", "lifecycle_status").alias("value"), "n")


def runtime_summary(entities: DataFrame, edges: DataFrame, relations: DataFrame, at: str) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(entities, "total_entities").crossJoin(one(entities.where("lifecycle_status = 'active'"), "active_entities"))
    return out.crossJoin(one(as_of(edges, at), "active_hierarchy")).crossJoin(one(as_of(relations, at), "active_relations"))


def replayed(events: DataFrame, up_to: str | None = None, cap: int = REPLAY_CAP) -> DataFrame:
    """The newest ``cap`` events, up to and without the first one later than ``up_to`` in order of seq (a break, not a filter)."""
    if cap:
        edge = events.select("seq").orderBy(F.desc("seq")).limit(cap).agg(F.min("seq").alias("__low"))
        events = events.join(F.broadcast(edge), F.col("seq") >= F.col("__low")).drop("__low")
    if up_to:
        edge = events.where(F.col("ts") > at_literal(up_to)).agg(F.min("seq").alias("__stop"))
        events = events.join(F.broadcast(edge), F.col("__stop").isNull() | (F.col("seq") < F.col("__stop"))).drop("__stop")
    return events


def recover(events: DataFrame, up_to: str | None = None, cap: int = REPLAY_CAP) -> DataFrame:
    """uid, entity_type, lifecycle_status, display_name, name_count of every entity that the log creates.

    The last creation resets type and status; a status counts only after a creation; the name is the last primary one.
    Closed forms of the fold: conditional aggregates, with a partial step.
    """
    return recovered(recovery_parts(replayed(events, up_to, cap)))


#: What recovery keeps of an entity. Each part is the last of its kind by seq, or a count, so parts of any split of a log merge.
PARTS = "born long, entity_type string, last_seq long, status string, named_seq long, display_name string, name_count long"


def recovery_parts(events: DataFrame) -> DataFrame:
    """uid and ``PARTS``: conditional aggregates, with a partial step."""
    rows = events.where(F.col("subject_entity").isNotNull() & (F.col("subject_entity") != ""))
    kind, seq = F.col("event_type"), F.col("seq")
    created = kind == "entity.created"
    status = F.create_map(*[F.lit(x) for kv in LIFECYCLE.items() for x in kv])
    known = F.when(F.col("entity_type").isin(*TYPES), F.col("entity_type")).otherwise("repo")
    named = F.coalesce(F.col("new_value"), F.lit("")) != ""
    life = kind.isin(*LIFECYCLE)
    primary = named & kind.isin("entity.created", "entity.renamed")
    return rows.groupBy(F.col("subject_entity").alias("uid")).agg(
        F.max(F.when(created, seq)).alias("born"), F.max_by(F.when(created, known), F.when(created, seq)).alias("entity_type"),
        F.max(F.when(life, seq)).alias("last_seq"), F.max_by(F.when(life, F.try_element_at(status, kind)), F.when(life, seq)).alias("status"),
        F.max(F.when(primary, seq)).alias("named_seq"), F.max_by(F.when(primary, F.col("new_value")), F.when(primary, seq)).alias("display_name"),
        F.count(F.when(named & kind.isin("entity.created", "entity.renamed", "name.added"), 1)).alias("name_count"),
    )


def recovered(parts: DataFrame) -> DataFrame:
    """The entities that parts (uid and ``PARTS``) make; those never created are none."""
    now = F.when(F.col("last_seq") > F.col("born"), F.col("status")).otherwise("active")
    return parts.where("born is not null").select("uid", "entity_type", now.alias("lifecycle_status"), "display_name", "name_count")


def verify_recovery(recovered: DataFrame, expected: DataFrame) -> DataFrame:
    """uid, problem, recovered, expected: missing, extra and mismatched entities; empty if all agree."""
    side = lambda df, n: df.select("uid", F.struct("lifecycle_status", "entity_type").alias(n))
    rows = side(recovered, "r").join(side(expected, "e"), "uid", "full")
    item = lambda ok, problem, a, b: F.when(ok, F.struct(F.lit(problem).alias("problem"), F.col(a).alias("recovered") if a else F.lit(None).cast("string").alias("recovered"), F.col(b).alias("expected") if b else F.lit(None).cast("string").alias("expected")))
    found = F.array(
        item(F.col("r").isNull(), "missing", None, None), item(F.col("e").isNull(), "extra", None, None),
        *[item(F.col(f"r.{f}") != F.col(f"e.{f}"), f, f"r.{f}", f"e.{f}") for f in ("lifecycle_status", "entity_type")],
    )
    return rows.select("uid", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("uid", "x.*")


def snapshot_diff(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """entity_id, field, old, new: one row a changed field (as text); a missing entity's fields are null, as a missing key is."""
    side = lambda df, n: df.select("entity_id", F.struct(*fields).alias(n))
    rows = side(before, "a").join(side(after, "b"), "entity_id", "full")
    changed = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("old"), F.col(f"b.{f}").cast("string").alias("new"))) for f in sorted(fields)]
    return rows.select("entity_id", F.explode(F.filter(F.array(*changed), lambda x: x.isNotNull())).alias("x")).select("entity_id", "x.*")


def compare_maps(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """As snapshot_diff, for a map column of any keys."""
    rows = before.select("entity_id", F.col(column).alias("a")).join(after.select("entity_id", F.col(column).alias("b")), "entity_id", "full")
    keys = F.array_union(F.coalesce(F.map_keys("a"), F.array().cast("array<string>")), F.coalesce(F.map_keys("b"), F.array().cast("array<string>")))
    rows = rows.withColumn("field", F.explode(keys)).select("entity_id", "field", F.try_element_at("a", "field").alias("old"), F.try_element_at("b", "field").alias("new"))
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


def registry_changes(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """entity_id, signal_type, field, previous_value, value: rows added and removed, and fields changed, of two states of a registry."""
    side = lambda df, n: df.select("entity_id", F.struct(*fields).alias(n))
    rows = side(before, "a").join(side(after, "b"), "entity_id", "full")
    gone, new = F.col("b").isNull(), F.col("a").isNull()
    none = F.lit(None).cast("string")
    event = lambda kind, field, a, b: F.struct(F.lit(kind).alias("signal_type"), field.alias("field"), a.alias("previous_value"), b.alias("value"))
    items = [F.when(new, event("file_created", none, none, none)), F.when(gone, event("file_deleted", none, none, none))]
    for f in sorted(fields):
        kind = "promotion_changed" if f == "promotion_status" else "registry_updated"
        items.append(F.when(~new & ~gone & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), event(kind, F.lit(f), F.col(f"a.{f}").cast("string"), F.col(f"b.{f}").cast("string"))))
    return rows.select("entity_id", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select("entity_id", "x.*")


def signatures(entities: DataFrame, edges: DataFrame, relations: DataFrame, at: str) -> DataFrame:
    """uid, parent_id, child_count, outgoing, incoming, depth, fingerprint."""
    return signatures_at(entities, edges, relations, [at])[0]


def signatures_at(entities: DataFrame, edges: DataFrame, relations: DataFrame, times: list[str]) -> list[DataFrame]:
    """The signatures at each of a few times: edges and relations are read once for all of them, and an entity's counts and parents
    are one row."""
    places = range(len(times))
    none, one = F.lit(None).cast("int"), F.lit(1)
    step = lambda key, name: F.struct(F.col(key).alias("uid"), *[(F.when(is_active(at), one) if n == name else none).alias(f"{n}_{i}") for i, at in enumerate(times) for n in _SIDES])
    held = F.expr(" or ".join(f"s.{n}_{i} is not null" for i in places for n in _SIDES))
    steps = lambda df, *sides: df.select(F.explode(F.array(*[step(*x) for x in sides])).alias("s")).where(held).select("s.*")
    counted = steps(edges, ("parent_id", "child_count")).union(steps(relations, ("source_id", "outgoing"), ("target_id", "incoming")))
    counted = counted.groupBy("uid").agg(*[F.count(f"{n}_{i}").cast("int").alias(f"{n}_{i}") for i in places for n in _SIDES])
    last = lambda at: F.max_by(F.when(is_active(at), F.col("parent_id")), F.when(is_active(at), F.col("seq")))
    # Of nodes that aren't entities only those on the way to a root matter.
    met = entities.select("uid").union(edges.select("parent_id")).distinct()
    up = edges.groupBy(F.col("child_id").alias("uid")).agg(*[last(at).alias(f"parent_id_{i}") for i, at in enumerate(times)])
    up = checkpointed(up.join(met, "uid", "left_semi"))
    known = checkpointed(entities.select("uid").join(counted, "uid", "left").join(up, "uid", "left"))
    out = []
    for i in places:
        depth = depths(up.select(F.col("uid").alias("node"), F.col(f"parent_id_{i}").alias("parent")).where("parent is not null")).select(F.col("node").alias("uid"), "depth")
        rows = known.select("uid", F.col(f"parent_id_{i}").alias("parent_id"), *[F.col(f"{n}_{i}").alias(n) for n in _SIDES]).join(depth, "uid", "left").na.fill(0, [*_SIDES, "depth"])
        out.append(rows.withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("child_count", "depth", "incoming", "outgoing", "parent_id")])))
    return out


_SIDES = ("child_count", "outgoing", "incoming")


def orphans(entities: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """Active entities without active parent or child."""
    rows = as_of(edges, at)
    tied = rows.select(F.col("parent_id").alias("uid")).union(rows.select("child_id"))
    return entities.where("lifecycle_status = 'active'").join(tied, "uid", "left_anti").select("uid", "entity_type")


def naming_conflicts(names: DataFrame, at: str) -> DataFrame:
    """slug, entity_count, entity_ids of slugs that several entities hold now; severity 0.7."""
    rows = names.where(is_active(at)).select(slug_of(names).alias("slug"), "entity_id").distinct()
    out = rows.groupBy("slug").agg(F.count("*").alias("entity_count"), F.array_sort(F.collect_list("entity_id")).alias("entity_ids")).where("entity_count > 1")
    return out.withColumn("severity", F.lit(0.7))


def overcoupling(relations: DataFrame, at: str, threshold: int = 5) -> DataFrame:
    """target_id, incoming, severity of entities with at least ``threshold`` active incoming relations; repeated ones count."""
    rows = as_of(relations, at).groupBy("target_id").agg(F.count("*").alias("incoming")).where(F.col("incoming") >= threshold)
    return rows.withColumn("severity", F.least(F.lit(1.0), F.col("incoming") / F.lit(2.0 * threshold)))


def last_status_window(events: DataFrame) -> DataFrame:
    """seq, uid, status after each event: the fold of ``recover`` at every step, by windows."""
    w = Window.partitionBy("subject_entity").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    status = F.create_map(*[F.lit(x) for kv in ({"entity.created": "active"} | LIFECYCLE).items() for x in kv])
    rows = events.withColumn("born", F.max(F.when(F.col("event_type") == "entity.created", F.col("seq"))).over(w))
    rows = rows.where("born is not null").withColumn("status", F.last(F.try_element_at(status, F.col("event_type")), True).over(w))
    return rows.select("seq", F.col("subject_entity").alias("uid"), "status")


def create_snapshots(entities: DataFrame, obs: DataFrame, signed: DataFrame, variables: DataFrame, at: str, properties=("entity_type", "lifecycle_status")) -> DataFrame:
    """One snapshot an entity: snapshot_id, entity_id, timestamp, properties, metric_values (latest), structural_fingerprint, and
    variable_bindings (variables of the entity). Maps are bounded by the numbers of metrics and keys."""
    entries = lambda df, key, value, name: df.groupBy(F.col("entity_id").alias("uid")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    bound = variables.where("entity_id is not null").groupBy("entity_id", "key").agg(F.min_by("value", "seq").alias("value"))
    out = entities.select("uid", F.create_map(*[x for p in properties for x in (F.lit(p), F.col(p).cast("string"))]).alias("properties"))
    for df in (entries(latest(obs), "metric_id", "value", "metric_values"), entries(bound, "key", "value", "variable_bindings"), signed.select("uid", F.col("fingerprint").alias("structural_fingerprint"))):
        out = out.join(df, "uid", "left")
    empty = lambda c, kind: F.coalesce(c, F.create_map().cast(f"map<string,{kind}>")).alias(c)
    millis = (F.unix_timestamp(F.lit(at).cast("timestamp")) * 1000).cast("bigint")
    return out.select(
        F.concat(F.lit("snap_"), ulid(millis, F.col("uid"))).alias("snapshot_id"), F.col("uid").alias("entity_id"), at_literal(at).alias("timestamp"), "properties", empty("metric_values", "double"),
        F.coalesce("structural_fingerprint", F.lit("")).alias("structural_fingerprint"), empty("variable_bindings", "string"),
    )


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity_id, fingerprint_changed, drift of entities in both tables of snapshots: whether anything but id and time differs."""
    maps = ("properties", "metric_values", "variable_bindings")
    side = lambda df, n: df.select("entity_id", F.struct("structural_fingerprint", *[F.array_sort(F.map_entries(m)).alias(m) for m in maps]).alias(n))
    rows = side(before, "a").join(side(after, "b"), "entity_id")
    turned = ~F.col("a.structural_fingerprint").eqNullSafe(F.col("b.structural_fingerprint"))
    return rows.select("entity_id", turned.alias("fingerprint_changed"), (~F.col("a").eqNullSafe(F.col("b"))).alias("drift"))


def signatures_differ(before: DataFrame, after: DataFrame) -> DataFrame:
    """uid, differ of entities in both tables of ``signatures``."""
    rows = before.select("uid", F.col("fingerprint").alias("a")).join(after.select("uid", F.col("fingerprint").alias("b")), "uid")
    return rows.select("uid", (F.col("a") != F.col("b")).alias("differ"))
