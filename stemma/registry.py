"""A registry as a value: a set of DataFrames. Every mutation returns a new registry with its event logged."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, metrics, mutate, resolve, rules, state, temporal
from .operators.temporal import at_literal
from .session import numbered
from .sources.store import Store


@dataclass(frozen=True)
class Registry:
    """Tables as ``plans.derived`` gives them; ``at`` is the time that now means."""

    entities: DataFrame
    names: DataFrame
    hierarchy: DataFrame
    relations: DataFrame
    lineage: DataFrame
    observations: DataFrame
    events: DataFrame
    variables: DataFrame
    at: str
    metrics: DataFrame | None = None
    versions: DataFrame | None = None

    def _logged(self, event_type: str, subjects: DataFrame, value: str | None = None, kind: str | None = None, more: tuple[str, ...] = (), **tables: DataFrame) -> Registry:
        text = lambda c: F.col(c) if c else F.lit(None).cast("string")
        turn = F.col("seq") if "seq" in subjects.columns else F.lit(0)
        rows = subjects.select(F.lit(event_type).alias("event_type"), F.col("uid").alias("subject_entity"), text(kind).alias("entity_type"), text(value).alias("new_value"), turn.cast("bigint").alias("__turn"), *more)
        rows = mutate.after(self.events, rows, ["__turn", "subject_entity", "new_value"]).withColumn("ts", at_literal(self.at)).drop("__turn")
        return replace(self, events=self.events.unionByName(rows, allowMissingColumns=True), **tables)

    def create(self, new: DataFrame) -> Registry:
        """new: uid, entity_type, display_name; seq, if they are to follow that order instead of that of uid."""
        turn = [c for c in new.columns if c == "seq"]
        named = mutate.add_edges(self.names, new.select(F.col("uid").alias("entity_id"), "display_name", F.lit(True).alias("is_primary"), *turn), self.at)
        return self._logged("entity.created", new, "display_name", "entity_type", entities=mutate.create(self.entities, new.select("uid", "entity_type", *turn)), names=named)

    def set_status(self, uids: DataFrame, status: str) -> Registry:
        kind = f"entity.{status}" if status in ("deprecated", "archived") else "entity.lifecycle_changed"
        return self._logged(kind, uids, entities=mutate.set_status(self.entities, uids, status))

    def rename(self, changes: DataFrame) -> Registry:
        return self._logged("entity.renamed", changes.withColumnRenamed("entity_id", "uid"), "display_name", names=mutate.rename(self.names, changes, self.at))

    def add_alias(self, aliases: DataFrame) -> Registry:
        return self._logged("name.added", aliases.withColumnRenamed("entity_id", "uid"), "display_name", names=mutate.add_alias(self.names, aliases, self.at))

    def relocate(self, moves: DataFrame, form: str = "store") -> Registry:
        return self._logged("entity.relocated", moves.withColumnRenamed("child_id", "uid"), "parent_id", hierarchy=mutate.relocate(self.hierarchy, moves, self.at, form))

    def reclassify(self, changes: DataFrame) -> Registry:
        return self._logged("entity.reclassified", changes, "entity_type", entities=mutate.reclassify(self.entities, changes))

    def merge(self, groups: DataFrame, form: str = "store") -> Registry:
        """The store form's event is one that recovery doesn't know; the ctx form's makes it take the successor as merged."""
        out = mutate.merge(self.entities, self.hierarchy, groups, self.at, form)
        uids = groups.select(F.col("successor").alias("uid")).distinct()
        return self._with_lineage(out["lineage"])._logged("entities.merged" if form == "store" else "entity.merged", uids, entities=out["entities"], hierarchy=out["edges"])

    def split(self, specs: DataFrame, form: str = "store", retire: bool = True) -> Registry:
        out = mutate.split(self.entities, self.hierarchy, specs, self.at, form, retire)
        return self._with_lineage(out["lineage"])._logged("entity.split", specs.select(F.col("source_uid").alias("uid")).distinct(), entities=out["entities"], hierarchy=out["edges"])

    def deprecate(self, uids: DataFrame) -> Registry:
        after, line = mutate.deprecate(self.entities, uids)
        return self._with_lineage(line)._logged("entity.deprecated", uids, entities=after)

    def _with_lineage(self, rows: DataFrame) -> Registry:
        """Appended in order of the rows' own seq, where they have one."""
        turn = F.col("seq") if "seq" in rows.columns else F.lit(0)
        new = mutate.after(self.lineage, rows.withColumn("__turn", turn).drop("seq"), ["__turn", "entity_id", "related_id", "lineage_type"]).drop("__turn")
        return replace(self, lineage=self.lineage.unionByName(new, allowMissingColumns=True))

    def add_lineage(self, rows: DataFrame) -> Registry:
        return self._with_lineage(rows)._logged("lineage.recorded", rows.select(F.col("entity_id").alias("uid")))

    def observe(self, rows: DataFrame) -> Registry:
        """rows: seq, metric_id, entity_id, value, ts."""
        return replace(self, observations=self.observations.unionByName(rows))

    def set_variables(self, log: DataFrame) -> Registry:
        """Sets that are not refused are logged, in order of seq."""
        whole = self.variables.unionByName(log, allowMissingColumns=True)
        done = log.join(rules.refused_sets(whole).select("seq"), "seq", "left_anti").withColumn("uid", F.coalesce("entity_id", F.lit("")))
        details = done.withColumn("changed_property", F.col("key")).withColumn("payload", F.to_json(F.struct("scope", "mutability")))
        return self._logged("variable.set", details, "value", None, ("changed_property", "payload"), variables=rules.set_variables(whole))

    def register_metrics(self, rows: DataFrame) -> Registry:
        """rows: metric_id and what else describes a metric; they replace those of equal id."""
        return replace(self, metrics=rows if self.metrics is None else mutate.upsert(self.metrics, rows, "metric_id"))

    def add_versions(self, rows: DataFrame) -> Registry:
        """rows as ``sources.store.create_versions`` makes them, appended in order of time and identifier."""
        start = rows.limit(0).withColumn("seq", F.lit(0).cast("bigint")) if self.versions is None else self.versions
        return replace(self, versions=start.unionByName(mutate.after(start, rows, ["timestamp", "version_id"]), allowMissingColumns=True))

    def resolve(self, wanted: DataFrame, entity_type: str | None = None) -> DataFrame:
        return resolve.resolve(wanted, self.entities, self.names, self.at, entity_type)

    def rollup(self, metric_id: str) -> DataFrame:
        return metrics.rollup(self.hierarchy, self.observations, metric_id, self.at)

    def state_at(self, at: str) -> DataFrame:
        return temporal.entity_state(self.entities, self.names, self.hierarchy, self.relations, at)

    def blast_radius(self, roots: DataFrame, max_depth: int = 3) -> DataFrame:
        return graph.blast_radius(self.hierarchy, self.relations, roots, self.at, max_depth)

    def recovered(self, up_to: str | None = None) -> DataFrame:
        return state.recover(self.events, up_to)

    def save(self, path: str) -> None:
        """Writes all tables as a store: keyed and listed files anew, logs rewritten in order of seq."""
        store = Store(self.entities.sparkSession, path)
        text = lambda df, *names: df.withColumns({c: F.date_format(c, _ISO) for c in names})
        store.save_keyed("entities", _objects(self.entities.drop("seq")), "uid")
        store.save_names(text(self.names, "valid_from", "valid_to"))
        store.save_edges(text(_objects(self.hierarchy), "valid_from", "valid_to"), text(_objects(self.relations), "valid_from", "valid_to"))
        store.rewrite("lineage", _objects(self.lineage))
        store.rewrite("observations", text(_objects(self.observations), "ts").withColumnRenamed("ts", "timestamp"))
        # What a creation says of its entity is in the payload, as an object.
        own = F.to_json(F.struct("entity_type", F.when(F.col("event_type") == "entity.created", F.col("new_value")).alias("display_name")))
        kept = F.col("payload") if "payload" in self.events.columns else F.lit(None).cast("string")
        events = _objects(self.events.withColumn("payload", F.coalesce(kept, own))).drop("entity_type")
        store.rewrite("events", text(events, "ts").withColumnRenamed("ts", "timestamp"))
        store.save_listed("variables", self.variables)
        if self.metrics is not None:
            store.save_keyed("metrics", _objects(self.metrics), "metric_id")
        if self.versions is not None:
            store.rewrite("versions", _objects(self.versions))


def _objects(df: DataFrame) -> DataFrame:
    """Columns that hold JSON as text, written as what they say."""
    text = [f.name for f in df.schema if f.name in ("payload", "metadata", "details") and f.dataType.typeName() == "string"]
    return df.withColumns({c: F.try_parse_json(c) for c in text})


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def open_store(spark: SparkSession, path: str, at: str) -> Registry:
    """The registry that a store holds, empty tables where files are missing. Entities are in order of uid, as they are saved;
    variables are set one after the other, constraints and constants being checked; a time that isn't one is null. The name that a
    creation gives is its payload's, where the event has no new value."""
    store = Store(spark, path)
    times = lambda df, *names: df.withColumns({c: F.expr(f"try_cast({c} as timestamp_ntz)") for c in names})
    logged = lambda df: times(df, "timestamp").withColumnRenamed("timestamp", "ts")
    window = ("valid_from", "valid_to")
    events = logged(store.events()).withColumn("entity_type", F.get_json_object("payload", "$.entity_type"))
    named = F.when((F.col("event_type") == "entity.created") & (F.coalesce("new_value", F.lit("")) == ""), F.get_json_object("payload", "$.display_name"))
    return Registry(
        numbered(store.entities(), ["uid"]), times(store.names(), *window), times(store.hierarchy_edges(), *window), times(store.relation_edges(), *window),
        store.lineage(), logged(store.observations()), events.withColumn("new_value", F.coalesce(named, "new_value")), rules.set_variables(store.variables()), at,
        store.metrics(), store.versions(),
    )
