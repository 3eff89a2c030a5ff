"""Identifiers to entities by a cascade of uid, current primary name, slug and any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..session import checkpointed
from .temporal import current_name


def slug_of(names: DataFrame) -> Column:
    """The slug that a name's row holds; derived from the display name where it holds none."""
    made = slugify(F.col("display_name"))
    return F.coalesce("slug", made) if "slug" in names.columns else made


def name_keys(names: DataFrame) -> DataFrame:
    """entity_id, slug (the stored one, else the display name's), lowered display name, seq (first use of each)."""
    rows = names.select("entity_id", slug_of(names).alias("slug"), F.lower("display_name").alias("lowered"), "seq")
    return rows.groupBy("entity_id", "slug", "lowered").agg(F.min("seq").alias("seq"))


def by_key(names: DataFrame, key: str) -> DataFrame:
    """key, entity_id, seq: the entities that have or had a slug (``slug``) or name (``lowered``), in order of first use."""
    return name_keys(names).groupBy(F.col(key).alias("key"), "entity_id").agg(F.min("seq").alias("seq"))


def ids_in_order(names: DataFrame, key: str) -> DataFrame:
    """key, entity_id, place: as ``by_key``, numbered from 1 for each key."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq", "entity_id"))
    return by_key(names, key).select("key", "entity_id", place.cast("bigint").alias("place"))


def narrowed(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """All names of the entities that an identifier may lead to, written: what no identifier asks for goes before anything is
    aggregated, in one pass over the names for their keys and one for the entities found."""
    ids = wanted.select("identifier").distinct()
    asked = ids.select(F.col("identifier").alias("__key")).union(ids.select(F.lower("identifier"))).distinct()
    keyed = names.select("entity_id", F.explode(F.array(slug_of(names), F.lower("display_name"))).alias("__key"))
    hit = keyed.join(asked, "__key", "left_semi").select("entity_id").union(ids.select("identifier")).distinct()
    return checkpointed(names.join(hit, "entity_id", "left_semi"))


def candidates(wanted: DataFrame, entities: DataFrame, names: DataFrame, at: str) -> DataFrame:
    """identifier, uid, matched_by, rank, seq: all ways in which identifiers (column identifier) lead to entities, by names that
    were ``narrowed``."""
    ids = wanted.select("identifier").distinct()
    some = names.select(F.col("entity_id").alias("uid")).union(ids.select("identifier")).distinct()
    own = entities.select("uid", "entity_type").join(some, "uid", "left_semi")
    uid = ids.join(own, ids["identifier"] == own["uid"]).select("identifier", "uid", "entity_type", F.lit("uid").alias("matched_by"), F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("seq"))
    display = ids.join(by_key(names, "lowered"), F.lower("identifier") == F.col("key")).select("identifier", F.col("entity_id").alias("uid"), "seq").join(own, "uid")
    now = current_name(names, at).where("is_primary").select(F.col("entity_id").alias("uid"), F.lower("display_name").alias("lowered"))
    primary = display.join(now, "uid").where(F.lower("identifier") == F.col("lowered"))
    slug = ids.join(by_key(names, "slug"), F.col("identifier") == F.col("key")).select("identifier", F.col("entity_id").alias("uid"), "seq").join(own, "uid")
    out = uid
    for df, name, rank in ((primary, "primary_name", 2), (slug, "slug", 3), (display, "alias", 4)):
        out = out.unionByName(df.select("identifier", "uid", "entity_type", F.lit(name).alias("matched_by"), F.lit(rank).alias("rank"), "seq"))
    return out


def resolve(wanted: DataFrame, entities: DataFrame, names: DataFrame, at: str, entity_type: str | None = None) -> DataFrame:
    """identifier, uid, matched_by, display_name: the first match of each identifier that has one; a uid of another type ends the search."""
    names = narrowed(wanted, names)
    rows = candidates(wanted, entities, names, at)
    if entity_type:
        rows = rows.where((F.col("rank") == 1) | (F.col("entity_type") == entity_type))
    best = rows.groupBy("identifier").agg(F.min(F.struct("rank", "seq", "uid", "matched_by", "entity_type")).alias("x")).select("identifier", "x.uid", "x.matched_by", "x.entity_type")
    best = best.where(F.col("entity_type") == entity_type) if entity_type else best
    shown = current_name(names, at).select(F.col("entity_id").alias("uid"), "display_name")
    return best.join(shown, "uid", "left").select("identifier", "uid", "matched_by", "display_name")


def resolve_all(wanted: DataFrame, entities: DataFrame, names: DataFrame, at: str, entity_type: str | None = None) -> DataFrame:
    """identifier, uid, matched_by, place: every entity once; uid first, then by any name (alias), then by slug."""
    rows = candidates(wanted, entities, narrowed(wanted, names), at).where("rank <> 2").withColumn("rank", F.element_at(F.array(F.lit(1), F.lit(0), F.lit(3), F.lit(2)), F.col("rank")))
    rows = rows.where(F.col("entity_type") == entity_type) if entity_type else rows
    once = rows.groupBy("identifier", "uid").agg(F.min(F.struct("rank", "seq", "matched_by")).alias("x")).select("identifier", "uid", "x.*")
    place = F.row_number().over(Window.partitionBy("identifier").orderBy("rank", "seq", "uid"))
    return once.select("identifier", "uid", "matched_by", place.alias("place"))
