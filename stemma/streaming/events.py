"""Structured Streaming over the event log: append, handlers, sensors, windows.

Sensors compare the last state with the new one per entity; their state is Spark's
state store (``applyInPandasWithState``) or, for snapshots, the batch operators of ``operators.state``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rules import normalize
from ..sources.schemas import CLAIM, EVENT


def event_stream(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """New lines of a log folder, malformed ones left out; ts is the timestamp."""
    x = F.from_json("value", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = spark.readStream.option("recursiveFileLookup", "true").text(path).select(x.alias("x")).where("x is not null and x.__bad is null").select("x.*").drop("__bad")
    return rows.withColumn("ts", F.try_to_timestamp("timestamp"))


def session_signals(spark: SparkSession, path: str) -> DataFrame:
    """Punch-ins and punch-outs of a claims log, as signals."""
    rows = event_stream(spark, path, CLAIM).where(F.col("action").isin("punch_in", "punch_out"))
    return rows.select(F.lit("session").alias("sensor_name"), F.lit("file_modified").alias("signal_type"), F.coalesce("repo", "organ").alias("entity_id"), F.coalesce("agent", "handle").alias("who"), "action", "ts")


def emit(changes: DataFrame) -> DataFrame:
    """Normalised changes as events ``sensor.<change>``."""
    return changes.select(F.concat(F.lit("sensor."), F.col("change_type")).alias("event_type"), F.col("source_sensor").alias("source"), F.col("entity_id").alias("subject_entity"), F.col("property_name").alias("changed_property"))


def signals_to_events(signals: DataFrame) -> DataFrame:
    return emit(normalize(signals))


class Bus:
    """Handlers of event types, ``*`` being all; a handler may be subscribed several times."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[DataFrame], None]]] = {}

    def subscribe(self, event_type: str, handler: Callable[[DataFrame], None]) -> None:
        self.handlers.setdefault(event_type, []).append(handler)

    def unsubscribe(self, event_type: str, handler: Callable[[DataFrame], None]) -> None:
        """Takes a handler's first subscription away; an unknown one changes nothing."""
        if handler in self.handlers.get(event_type, []):
            self.handlers[event_type].remove(handler)

    def clear(self) -> None:
        self.handlers.clear()

    def attach(self, stream: DataFrame, checkpoint: str):
        return dispatch(stream, self.handlers, checkpoint)


def dispatch(stream: DataFrame, handlers: dict[str, list[Callable[[DataFrame], None]]], checkpoint: str):
    """Runs each batch through the handlers of its types, then those of ``*``; an exception ends the query and the batch is run again."""

    def batch(df: DataFrame, _: int) -> None:
        for kind, called in handlers.items():
            if kind != "*":
                for f in called:
                    f(df.where(F.col("event_type") == kind))
        for f in handlers.get("*", []):
            f(df)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def value_changes(stream: DataFrame) -> DataFrame:
    """entity_id, previous_value, value of each change of value of (entity_id, seq, value) rows; a first value seeds the state and is silent."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = pd.concat(list(parts)).sort_values("seq")["value"]
        values = values.astype(object).where(values.notna(), None).reset_index(drop=True)
        old = values.shift(1)
        old.iloc[0] = state.get[0] if state.exists else values.iloc[0]
        old = old.where(old.notna(), None)
        moved = (values != old) & ~(values.isna() & old.isna())
        state.update((values.iloc[-1],))
        yield pd.DataFrame({"entity_id": key[0], "previous_value": old[moved], "value": values[moved]})

    return stream.groupBy("entity_id").applyInPandasWithState(step, "entity_id string, previous_value string, value string", "value string", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts and sums by event time, final once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
