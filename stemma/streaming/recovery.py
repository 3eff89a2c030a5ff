"""Recovery as a stream: the fold of the event log kept per entity in Spark's state store, from a snapshot on.

What is kept of an entity (``state.PARTS``) is the last of each kind by seq, and a count, so the result is that of the
batch recovery however the log is split into batches. The fold is a streaming aggregate: an entity's events of a batch are
merged before they are shuffled, and its state is read and written once a batch, so a hot entity takes no more memory. Changed entities are written to a folder of the batch's number, which a batch that is run again
overwrites, so each change is there once. The state store is RocksDB, so state may exceed memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import LIFECYCLE, PARTS, TYPES, recovered
from ..sources.store import _exists

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _merged() -> list:
    """Aggregates that merge parts: the last of each kind by its seq, and the count."""
    last = lambda value, at: F.max_by(F.when(F.col(at).isNotNull(), F.col(value)), at).alias(value)
    pairs = (("born", "entity_type"), ("last_seq", "status"), ("named_seq", "display_name"))
    return [*[x for at, value in pairs for x in (F.max(at).alias(at), last(value, at))], F.sum("name_count").alias("name_count")]


def event_parts(events: DataFrame) -> DataFrame:
    """A stream of events as parts of one event each (see ``state.recovery_parts``)."""
    kind, seq = F.col("event_type"), F.col("seq")
    status = F.create_map(*[F.lit(x) for kv in LIFECYCLE.items() for x in kv])
    named = F.coalesce(F.col("new_value"), F.lit("")) != ""
    primary = named & kind.isin("entity.created", "entity.renamed")
    created, life = kind == "entity.created", kind.isin(*LIFECYCLE)
    rows = events.where(F.col("subject_entity").isNotNull() & (F.col("subject_entity") != ""))
    return rows.select(
        F.col("subject_entity").alias("uid"), F.when(created, seq).alias("born"), F.when(created, F.when(F.col("entity_type").isin(*TYPES), F.col("entity_type")).otherwise("repo")).alias("entity_type"),
        F.when(life, seq).alias("last_seq"), F.when(life, F.try_element_at(status, kind)).alias("status"), F.when(primary, seq).alias("named_seq"), F.when(primary, F.col("new_value")).alias("display_name"),
        F.when(named & kind.isin("entity.created", "entity.renamed", "name.added"), 1).otherwise(0).cast("long").alias("name_count"),
    )


def recover_stream(events: DataFrame, out: str, checkpoint: str, snapshot: DataFrame | None = None):
    """Starts the fold over a stream of events (seq, event_type, subject_entity, entity_type, new_value) and writes changed entities
    below ``out``, a folder a batch. snapshot: uid and ``state.PARTS``, what earlier events left; it is written beside the checkpoint
    at the first start and streamed into the state once, with the first batch; a later start with it, or without, goes on as it was.
    Returns the query; with an available-now trigger it ends at the end of the input.
    """
    spark = events.sparkSession
    names, kept = ["uid", *(x.split()[0] for x in PARTS.split(", "))], f"{checkpoint.rstrip('/')}-snapshot"
    if snapshot is not None and not _exists(spark, f"{checkpoint}/metadata"):
        snapshot.select(*names).write.mode("overwrite").parquet(kept)
    parts = event_parts(events).select(*names)
    if _exists(spark, f"{kept}/_SUCCESS"):
        parts = parts.unionByName(spark.readStream.schema(f"uid string, {PARTS}").parquet(kept))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        state = parts.groupBy("uid").agg(*_merged()).select(*names)

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        return state.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def recovered_so_far(spark: SparkSession, out: str, snapshot: DataFrame | None = None) -> DataFrame:
    """The entities as the last batch left each; those of the snapshot that no batch has changed as they were."""
    names = ["uid", *(x.split()[0] for x in PARTS.split(", "))]
    rows = spark.read.schema(f"uid string, {PARTS}, batch long").parquet(out)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select(*names).withColumn("batch", F.lit(-1).cast("long")))
    last = rows.groupBy("uid").agg(F.max_by(F.struct(*names[1:]), "batch").alias("x")).select("uid", "x.*")
    return recovered(last)
