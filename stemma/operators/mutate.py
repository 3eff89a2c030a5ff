"""Mutations as batch rewrites: each takes tables and requests, and returns new tables.

Edges are an append-only log with windows: a mutation closes open rows and appends
new ones, so readers of the old tables are never disturbed. The two families of
merge and split differ on purpose and stay apart: ``store`` inherits the parents
of every source and leaves the sources deprecated; ``ctx`` inherits the first
source's parents only and leaves the sources merged (split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import numbered
from .temporal import at_literal, is_active


def after(log: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with seq: numbers past the last of ``log``, in the given order."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__top"))
    return numbered(rows, order).crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("__top")).drop("__top")


def create(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Appends rows (uid, entity_type) as active, after the last seq: in order of their own seq if they have one, else of uid."""
    order = ["seq", "uid"] if "seq" in new.columns else ["uid"]
    ordered = new.select("uid", "entity_type", *[F.col(c).alias(f"__{c}") for c in order])
    rows = after(entities, ordered, [f"__{c}" for c in order]).select("seq", "uid", "entity_type", F.lit("active").alias("lifecycle_status"))
    return entities.unionByName(rows, allowMissingColumns=True)


def set_status(entities: DataFrame, uids: DataFrame, status: str) -> DataFrame:
    """uids: uid. Unknown ones change nothing."""
    hit = uids.select("uid").distinct().withColumn("__hit", F.lit(True))
    return entities.join(hit, "uid", "left").withColumn("lifecycle_status", F.when(F.col("__hit"), status).otherwise(F.col("lifecycle_status"))).drop("__hit")


def reclassify(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: uid, entity_type."""
    new = changes.select("uid", F.col("entity_type").alias("__new"))
    return entities.join(new, "uid", "left").withColumn("entity_type", F.coalesce("__new", "entity_type")).drop("__new")


def rename(names: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """changes: entity_id, display_name. Open primary names close at ``at``; the new one is primary."""
    hit = changes.select("entity_id").distinct().withColumn("__hit", F.lit(True))
    closes = F.col("__hit") & F.col("is_primary") & is_active(at)
    old = names.join(hit, "entity_id", "left").withColumns(
        {"valid_to": F.when(closes, at_literal(at)).otherwise(F.col("valid_to")), "is_primary": F.col("is_primary") & ~F.coalesce(closes, F.lit(False))}
    ).drop("__hit")
    return _append(old, changes.select("entity_id", "display_name", F.lit(True).alias("is_primary")), at)


def add_alias(names: DataFrame, aliases: DataFrame, at: str) -> DataFrame:
    return _append(names, aliases.select("entity_id", "display_name", F.lit(False).alias("is_primary")), at)


def retire_name(names: DataFrame, retired: DataFrame, at: str) -> DataFrame:
    """retired: entity_id, display_name. Closes the open windows; whether it is primary stays as it is."""
    hit = retired.select("entity_id", "display_name").distinct().withColumn("__hit", F.lit(True))
    return names.join(hit, ["entity_id", "display_name"], "left").withColumn("valid_to", F.when(F.col("__hit") & is_active(at), at_literal(at)).otherwise(F.col("valid_to"))).drop("__hit")


def _append(log: DataFrame, rows: DataFrame, at: str, order: list[str] | None = None) -> DataFrame:
    """New rows follow the last seq, in order of the columns ``order`` (which go), of their own seq, or of all their columns."""
    if order is None and "seq" in rows.columns:
        rows, order = rows.withColumnRenamed("seq", "__turn"), ["__turn"]
    new = after(log, rows, order or rows.columns).drop(*order or [])
    new = new.withColumn("valid_from", at_literal(at)).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return log.unionByName(new, allowMissingColumns=True)


def add_edges(edges: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    return _append(edges, rows, at)


def retire_edges(edges: DataFrame, retired: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Closes the first active row of each key in ``retired``."""
    first = edges.where(is_active(at)).join(retired.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("seq").alias("__first"))
    rows = edges.join(first, keys, "left")
    return rows.withColumn("valid_to", F.when(F.col("seq") == F.col("__first"), at_literal(at)).otherwise(F.col("valid_to"))).drop("__first")


def _close(edges: DataFrame, keys: DataFrame, column: str, at: str) -> DataFrame:
    hit = keys.distinct().withColumn("__hit", F.lit(True))
    return edges.join(hit, column, "left").withColumn("valid_to", F.when(F.col("__hit") & is_active(at), at_literal(at)).otherwise(F.col("valid_to"))).drop("__hit")


def relocate(edges: DataFrame, moves: DataFrame, at: str, form: str = "store") -> DataFrame:
    """moves: child_id, parent_id. ``store`` closes all active parent edges of a child, ``ctx`` only the first edge from its last parent."""
    if form == "store":
        return _append(_close(edges, moves.select("child_id"), "child_id", at), moves.select("parent_id", "child_id"), at)
    last = edges.where(is_active(at)).join(moves.select("child_id").distinct(), "child_id", "left_semi").groupBy("child_id").agg(F.max_by("parent_id", "seq").alias("parent_id"))
    return _append(retire_edges(edges, last, ["parent_id", "child_id"], at), moves.select("parent_id", "child_id"), at)


def merge(entities: DataFrame, edges: DataFrame, groups: DataFrame, at: str, form: str = "store") -> dict[str, DataFrame]:
    """groups: seq, source_uid, successor. Returns entities, edges, opened (new edges), lineage (seq: its turn) and result (counts by successor).

    Children of every source move to the successor. A successor takes its first source's type. New edges follow the order of
    the sources: of each its children's, then its parents', as their edges were appended.
    """
    known = groups.join(entities.select(F.col("uid").alias("source_uid"), "entity_type"), "source_uid")
    active = edges.where(is_active(at))
    place = lambda kind: [F.col("__turn"), F.lit(kind).alias("__kind"), F.col("seq").alias("__edge")]
    turn = known.select("source_uid", "successor", F.col("seq").alias("__turn"))
    kids = active.join(turn.withColumnRenamed("source_uid", "parent_id"), "parent_id").select(F.col("successor").alias("parent_id"), "child_id", *place(0))
    heirs = turn if form == "store" else turn.groupBy("successor").agg(F.min_by("source_uid", "__turn").alias("source_uid"), F.min("__turn").alias("__turn"))
    ups = active.join(heirs.withColumnRenamed("source_uid", "child_id"), "child_id").select("parent_id", F.col("successor").alias("child_id"), *place(1))
    moved = kids.withColumn("successor", F.col("parent_id")).unionByName(ups.withColumn("successor", F.col("child_id")))
    opened = moved.drop("successor")
    closed = _close(edges, known.select(F.col("source_uid").alias("parent_id")), "parent_id", at)
    closed = _close(closed, heirs.select(F.col("source_uid").alias("child_id")), "child_id", at)
    new = known.groupBy(F.col("successor").alias("uid")).agg(F.min_by("entity_type", "seq").alias("entity_type"), F.min("seq").alias("seq"))
    changed = set_status(create(entities, new), known.select(F.col("source_uid").alias("uid")), "deprecated" if form == "store" else "merged")
    line = known.select((F.col("seq") * 2 + 1).alias("seq"), F.col("source_uid").alias("entity_id"), F.col("successor").alias("related_id"), F.lit("merged_into").alias("lineage_type"))
    if form == "ctx":
        line = line.unionByName(known.select((F.col("seq") * 2).alias("seq"), F.col("successor").alias("entity_id"), F.col("source_uid").alias("related_id"), F.lit("derived_from").alias("lineage_type")))
    records = 2 if form == "ctx" else 1
    result = known.groupBy("successor").agg(F.count("*").alias("sources")).join(moved.groupBy("successor").agg(F.count("*").alias("edges")), "successor", "left")
    result = result.select("successor", "sources", (F.col("sources") * records).alias("lineage_records"), F.coalesce("edges", F.lit(0)).alias("edges_closed"), F.coalesce("edges", F.lit(0)).alias("edges_created"))
    order = ["__turn", "__kind", "__edge"]
    return {"entities": changed, "edges": _append(closed, opened, at, order), "opened": opened.drop(*order), "lineage": line, "result": result}


def split(entities: DataFrame, edges: DataFrame, specs: DataFrame, at: str, form: str = "store", retire: bool = True) -> dict[str, DataFrame]:
    """specs: source_uid, descendant, and seq if lineage is to follow that order. Descendants take the source's type and, in the store form, its parents; an empty name is left out."""
    known = specs.where("descendant <> ''").join(entities.select(F.col("uid").alias("source_uid"), "entity_type"), "source_uid")
    active = edges.where(is_active(at))
    opened = active.join(known.select(F.col("source_uid").alias("child_id"), "descendant"), "child_id").select("parent_id", F.col("descendant").alias("child_id"), F.col("child_id").alias("__source"), F.col("seq").alias("__edge"))
    opened = opened if form == "store" else opened.limit(0)
    changed = create(entities, known.select(F.col("descendant").alias("uid"), "entity_type"))
    sources = known.select(F.col("source_uid").alias("uid"))
    if form == "ctx":
        changed = set_status(changed, sources, "split")
    elif retire:
        changed = set_status(changed, sources, "deprecated")
        edges = _close(edges, sources.select(F.col("uid").alias("child_id")), "child_id", at)
    turn = [c for c in ("seq",) if c in specs.columns]
    line = known.select(*turn, F.col("descendant").alias("entity_id"), F.col("source_uid").alias("related_id"), F.lit("split_from").alias("lineage_type"))
    result = known.groupBy("source_uid").agg(F.count("*").alias("descendants")).join(opened.groupBy(F.col("__source").alias("source_uid")).agg(F.count("*").alias("edges")), "source_uid", "left")
    result = result.select("source_uid", "descendants", F.coalesce("edges", F.lit(0)).alias("edges_created"))
    new = opened.withColumn("__child", F.col("child_id"))
    return {"entities": changed, "edges": _append(edges, new, at, ["__source", "__child", "__edge"]), "opened": opened.drop("__source", "__edge"), "lineage": line, "result": result}


def deprecate(entities: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """uids: uid, successor (may be null), and seq if lineage is to follow that order. Returns entities and supersedes lineage."""
    line = uids.where("successor is not null").select(*[c for c in ("seq",) if c in uids.columns], F.col("successor").alias("entity_id"), F.col("uid").alias("related_id"), F.lit("supersedes").alias("lineage_type"))
    return set_status(entities, uids, "deprecated"), line


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of equal key (metrics, variables by id)."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
