"""Sensors as differences of two states, and what becomes of their signals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources.store import repositories, tracked
from .rules import normalize
from .state import registry_changes

SIGNAL = ("sensor_name", "signal_type", "entity_id", "previous_value", "value")


def _signals(df: DataFrame, sensor: str, kind, old=None, new=None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return df.select(F.lit(sensor).alias("sensor_name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("signal_type"), "entity_id", text(old).alias("previous_value"), text(new).alias("value"))


def filesystem_signals(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """entity_id sets of two scans: created and deleted ones; the first scan only seeds."""
    if before is None:
        return _signals(after.limit(0), "filesystem", "file_created")
    new = after.select("entity_id").subtract(before.select("entity_id"))
    gone = before.select("entity_id").subtract(after.select("entity_id"))
    return _signals(new, "filesystem", "file_created").unionByName(_signals(gone, "filesystem", "file_deleted"))


def ci_signals(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Flips of has_ci; an absent repository has none."""
    if before is None:
        return _signals(after.limit(0), "ci", "registry_updated")
    rows = before.select("entity_id", F.col("has_ci").alias("a")).join(after.select("entity_id", F.col("has_ci").alias("b")), "entity_id", "full").na.fill(False, ["a", "b"])
    return _signals(rows.where("a <> b"), "ci", "registry_updated", F.col("a"), F.col("b"))


def git_signals(commits: DataFrame) -> DataFrame:
    return _signals(commits, "git", "git_commit", None, F.col("commits"))


def relation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity_id, target_id, relation_type) of two states: added and removed relations."""
    keys = ["entity_id", "target_id", "relation_type"]
    mark = lambda df, kind: df.withColumn("signal_type", F.lit(kind))
    return mark(after.select(*keys).subtract(before.select(*keys)), "edge_added").unionByName(mark(before.select(*keys).subtract(after.select(*keys)), "edge_removed"))


def scan_all(*signals: DataFrame) -> DataFrame:
    """Normalised changes of all sensors."""
    return normalize(reduce(lambda a, b: a.unionByName(b), signals))


@dataclass(frozen=True)
class Sensor:
    """A named source of signals; one that isn't available is not asked."""

    name: str
    scan: Callable[[], DataFrame]
    available: Callable[[], bool] = lambda: True


def scan_sensors(spark: SparkSession, sensors: list[Sensor]) -> tuple[DataFrame, list[str]]:
    """(normalised changes, names of sensors that failed). Each sensor's signals are written when it is asked, so that one that
    fails, on the driver or in a task, doesn't break the scan."""
    found, failed = [], []
    for sensor in sensors:
        if sensor.available():
            try:
                found.append(checkpointed(sensor.scan()))
            except Exception:  # noqa: BLE001
                failed.append(sensor.name)
    nothing = spark.createDataFrame([], ", ".join(f"{c} string" for c in SIGNAL))
    return scan_all(nothing, *found), failed


#: Fields of a registry's repositories whose changes count.
TRACKED = ("status", "tier", "promotion_status", "implementation_status", "ci_workflow")


def content_hash(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of a file, or null if there is none."""
    try:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()
    except Exception:  # noqa: BLE001
        return None
    return found[0][0] if found else None


def scan_registry(spark: SparkSession, path: str, last: tuple[str, DataFrame] | None = None) -> tuple[DataFrame, tuple[str, DataFrame] | None]:
    """(signals, what to hand on to the next scan) of a source registry's file.

    The first scan only seeds. An equal content hash ends the scan. A file that isn't JSON gives one signal, and its predecessor's
    repositories stay what the next scan compares with.
    """
    nothing = spark.createDataFrame([], ", ".join(f"{c} string" for c in SIGNAL))
    now = content_hash(spark, path)
    if now is None or last is not None and now == last[0]:
        return nothing, last
    sound = bool(spark.read.text(path, wholetext=True).where(F.try_parse_json("value").isNotNull()).count())
    repos = checkpointed(tracked(repositories(spark, path))) if sound else None
    if last is None:
        return nothing, (now, repos if sound else spark.createDataFrame([], ", ".join(f"{c} string" for c in ("entity_id", *TRACKED))))
    if not sound:
        return spark.createDataFrame([("registry", "registry_updated", "registry-v2", None, "parse_failure")], nothing.schema), (now, last[1])
    changes = registry_changes(last[1], repos, list(TRACKED))
    return _signals(changes, "registry", F.col("signal_type"), F.col("previous_value"), F.col("value")), (now, repos)
