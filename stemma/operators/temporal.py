"""As-of filters, names, parents, entity states and structural diffs.

Windows are half-open: active at t if valid_from <= t and valid_to is null or > t.
"Last" is the largest ``seq``, never the latest time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_literal(at: str) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def is_active(at: str | Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    at = at_literal(at) if isinstance(at, str) else at
    return (F.col(valid_from) <= at) & (F.col(valid_to).isNull() | (F.col(valid_to) > at))


def as_of(edges: DataFrame, at: str, relation_type: str | None = None) -> DataFrame:
    rows = edges.where(is_active(at))
    return rows.where(F.col("relation_type") == relation_type) if relation_type else rows


def last_by(df: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """One row a key, that of the largest ``order``: an aggregate with a partial step, so hot keys stay cheap."""
    best = F.max_by(F.struct(*names), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__x")).select(*keys, *[F.col(f"__x.{n}").alias(n) for n in names])


def current_name(names: DataFrame, at: str) -> DataFrame:
    """entity_id, display_name, is_primary: the last active primary name, else the last active one."""
    return last_by(names.where(is_active(at)), ["entity_id"], ["is_primary", "seq"], ["display_name", "is_primary"])


def name_history(names: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """entity_id, place, display_name, is_primary, valid_from, valid_to: all names of each entity (entity_id) asked for, as appended."""
    rows = names if entities is None else names.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("seq")).cast("bigint")
    return rows.select("entity_id", place.alias("place"), "display_name", "is_primary", "valid_from", "valid_to")


def parent_of(edges: DataFrame, at: str) -> DataFrame:
    """child_id, parent_id: the last active parent edge of each child."""
    return last_by(edges.where(is_active(at)), ["child_id"], ["seq"], ["parent_id"])


def children_of(edges: DataFrame, at: str, parents: DataFrame | None = None) -> DataFrame:
    rows = edges.where(is_active(at))
    return rows if parents is None else rows.join(parents.select("parent_id").distinct(), "parent_id", "left_semi")


def relations_of(relations: DataFrame, at: str, relation_type: str | None = None, incoming: bool = False) -> DataFrame:
    """entity_id, other_id, relation_type, seq."""
    one, other = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    return as_of(relations, at, relation_type).select(F.col(one).alias("entity_id"), F.col(other).alias("other_id"), "relation_type", "seq")


def entity_state(entities: DataFrame, names: DataFrame, edges: DataFrame, relations: DataFrame, at: str) -> DataFrame:
    """The state of every entity at a time: name, parent and counts of children and relations; type and status are the current ones."""
    none, one = F.lit(None), F.lit(1)
    sides = ("child_count", "outgoing_count", "incoming_count")
    # What edges and relations say of the entities at both ends, in one reading of each and one aggregate.
    part = lambda key, name=None, parent=none, seq=none: F.struct(F.col(key).alias("uid"), *[(one if n == name else none.cast("int")).alias(n) for n in sides], parent.cast("string").alias("parent_id"), seq.cast("bigint").alias("seq"))
    parts = lambda df, *each: df.where(is_active(at)).select(F.explode(F.array(*each)).alias("p")).select("p.*")
    tied = parts(edges, part("parent_id", "child_count"), part("child_id", None, F.col("parent_id"), F.col("seq"))).union(parts(relations, part("source_id", "outgoing_count"), part("target_id", "incoming_count")))
    tied = tied.groupBy("uid").agg(F.max_by("parent_id", "seq").alias("parent_id"), *[F.count(n).alias(n) for n in sides])
    named = current_name(names, at).select(F.col("entity_id").alias("uid"), F.col("display_name").alias("primary_name"))
    out = entities.select("uid", "entity_type", "lifecycle_status").join(named, "uid", "left").join(tied, "uid", "left")
    return out.na.fill(0, list(sides))


def structural_diff(edges: DataFrame, relations: DataFrame, at_a: str, at_b: str) -> DataFrame:
    """For each entity whose surroundings differ between two times: its parents, and children and outgoing relations gained and lost.

    Incoming relations don't count. Arrays are sorted.
    """
    both = lambda a, b: F.when(a & b, 3).when(a, 1).when(b, 2)
    a, b = is_active(at_a), is_active(at_b)
    state = lambda df, *keys: df.select(*keys, both(a, b).alias("s")).where("s is not null").groupBy(*[F.col(k) for k in keys]).agg(F.bit_or("s").alias("s")).where("s < 3")
    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("s") == s, F.col("x"))))
    kids = state(edges, "parent_id", "child_id").select(F.col("parent_id").alias("uid"), F.col("child_id").alias("x"), "s")
    kids = kids.groupBy("uid").agg(listed(2).alias("children_added"), listed(1).alias("children_removed"))
    rels = state(relations, "source_id", "target_id", "relation_type").select(F.col("source_id").alias("uid"), F.concat_ws("|", "target_id", "relation_type").alias("x"), "s")
    rels = rels.groupBy("uid").agg(listed(2).alias("relations_added"), listed(1).alias("relations_removed"))
    old, new = (parent_of(edges, t).select(F.col("child_id").alias("uid"), F.col("parent_id").alias(n)) for t, n in ((at_a, "parent_before"), (at_b, "parent_after")))
    parents = old.join(new, "uid", "full").where(~F.col("parent_before").eqNullSafe(F.col("parent_after")))
    out = parents.join(kids, "uid", "full").join(rels, "uid", "full")
    empty = F.array().cast("array<string>")
    return out.select("uid", "parent_before", "parent_after", *[F.coalesce(c, empty).alias(c) for c in ("children_added", "children_removed", "relations_added", "relations_removed")])


def rotate_primary(log: DataFrame) -> DataFrame:
    """Validity windows from a log of names (entity_id, display_name, valid_from, is_primary, seq): a new primary closes the open one."""
    following = F.lead("valid_from").over(Window.partitionBy("entity_id", "is_primary").orderBy("seq"))
    return log.withColumn("valid_to", F.when(F.col("is_primary"), following)).withColumn("is_current", F.col("is_primary") & F.col("valid_to").isNull())


def rotate_parent(log: DataFrame) -> DataFrame:
    """Validity windows from a log of moves (child_id, parent_id, valid_from, seq): a new parent closes the open edge."""
    return log.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("child_id").orderBy("seq")))
